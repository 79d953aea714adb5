"""Private keys are masked through their bodies, with and without an END line."""

import base64
import random

import pytest

from pagelattice.llm import secrets

FIRST, LAST = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def lines(n, seed=1):
    digits = base64.b64encode(random.Random(seed).randbytes(48 * n + 10)).decode()
    return [digits[i:i + 64] for i in range(0, len(digits), 64)]


@pytest.mark.parametrize("ended", [True, False])
@pytest.mark.parametrize(("before", "between"), [("\n", "\n"), ("\r\n", "\r\n"), ("\n    ", "\n    "), (" ", " "), ("\\n", "\\n"), ("\\\\n", "\\\\n"), ('\\n" +\n  "', '\\n" +\n  "'),
                                                ("\n> ", "\n> "), ("", "\n"), ("\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,8A0F11\n\n", "\n")])
def test_no_line_of_a_key_is_left(spark, before, between, ended):
    body = lines(25)
    text = f"See 😀 {FIRST}{before}{between.join(body)}{between}{LAST if ended else ''}\nThe end, of it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    clean = secrets.redacted(docs).first().text
    assert clean.startswith("See 😀 [secret]") and clean.endswith(", of it.")
    assert not any(x in clean for x in body) and "PRIVATE" not in clean and "DEK-Info" not in clean
    assert clean.endswith("[secret]\nThe end, of it.") or not ended


def test_other_text_stays(spark):
    escaped = "\\n".join(x.replace("/", "\\/") for x in lines(25, 3))
    rows = [(1, f"a {FIRST} in prose, and more words after it -----BEGIN CERTIFICATE-----\nabc"), (2, f"{FIRST}\n" + "\n".join(lines(40_000)) + "\n!"),
            (3, f"{FIRST}\n" + "\n".join(lines(9)) + f"\n{LAST} kept {FIRST}\n" + "\n".join(lines(9, 2)) + f"\n{LAST}"), (4, f"{FIRST}\\n{escaped}\"}}, kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[1] == "a [secret] in prose, and more words after it -----BEGIN CERTIFICATE-----\nabc"
    assert clean[2] == "[secret]\n!" and clean[3] == "[secret] kept [secret]" and clean[4] == '[secret]"}, kept'
    assert secrets.trigram_query(secrets.RULES[3].pattern) == secrets.trigram_query("-----BEGIN [A-Z ]*PRIVATE KEY-----")
