from __future__ import annotations

from pagelattice.derived import Tables, with_clause

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, uses: str = "", also: str = ""):
    """Register ``fn(tables) -> DataFrame``. ``uses`` names derived tables the SQL starts from,
    ``also`` adds common table expressions after them."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ctes = ",\n".join(x for x in (with_clause(*uses.split()) if uses else "", also.strip()) if x)
            ORACLES[name] = (f"WITH RECURSIVE {ctes}\n" if ctes else "") + sql.strip()
        return fn

    return wrap
