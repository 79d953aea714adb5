"""Token counts use vocabulary entries of any length."""

import public_tokenizers

from pagelattice.llm import token_counts
from pagelattice.llm.pretokens import read_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_entries_of_any_length():
    of, _, added = read_bpe(PATH)
    scores = token_counts.scores_of(PATH)
    assert set(scores) == {t for i, t in enumerate(of) if t and i not in set(added.values())}
    trie = token_counts.CountingTrie(scores)
    for raw in [b"-" * 64, b"=" * 64, b"-" * 200, b" " * 90 + b"x", *(t for t in scores if len(t) > 32)]:
        best = [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            best.append(max((best[s][0] + scores[raw[s:end]], best[s][1] - 1) for s in range(end) if raw[s:end] in scores))
        assert trie.insert(raw) == -best[-1][1]
    assert trie.insert(b"-" * 64) == 1
