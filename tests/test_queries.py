"""Every query of the library's own operators against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltwork.plans import registry  # noqa: E402
from tools.compare import duck, rows_of  # noqa: E402

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got, columns = rows_of(df.columns, df.collect())
    if name in registry.ORACLES:
        names, rows = duck(SF, registry.ORACLES[name])
        want, expected = rows_of(names, rows)
        assert columns == expected
        assert got == want
    else:
        assert got


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_structural_chunks_of_long_words_match_sql(spark, tmp_path):
    """Sections whose chunks have more than 8,000 characters, and white space that isn't SQL's."""
    texts = [" ".join(f"{'long' * 4}{i}" for i in range(2500)), "\n".join(f"wide\u00a0word{i}" for i in range(700)), "", None]
    rows = spark.createDataFrame([(i, texts[i % 4]) for i in range(24)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["structural_chunks"](spark, str(tmp_path))
    got, columns = rows_of(df.columns, df.collect())
    names, want = duck_of(f"{tmp_path}/documents.parquet/*.parquet", registry.ORACLES["structural_chunks"])
    assert (got, columns) == rows_of(names, want)[:2]


def test_chunk_sidecar_leaves_tables_of_contents_out(spark, tmp_path):
    """Contents alone, amid prose, few, numbered, wrapped, and beside white space and digits that aren't SQL's."""
    dotted = "\n".join(f"Part {i} of the book....... {i * 3}" for i in range(40))
    numbered = "\n".join(f"{i}.{i % 4} On part{i}  {i * 7}" for i in range(60))
    prose = lambda n, w: "\n".join(" ".join(f"{w}{i}x{j}" for j in range(90)) + "." for i in range(n))
    texts = [
        dotted, numbered.replace("  ", " \x0b\t"), dotted.replace("\n", "\r\n \t\r\n"), f"{dotted}\n{numbered}\n" * 9, dotted.replace(" of the", "\nof the"), "", None,
        f"{prose(2, 'a')}\n{dotted}\n{prose(5, 'b')}", f"{numbered}\n{prose(4, 'a')}", prose(6, "a"), f"Part one.... 1\nPart two.... 2\n{prose(1, 'a')}", dotted.replace("....... ", ".......\u00a0"), dotted.replace("\n", ". "),
        "\n".join(f"{i} \u0661 {i}\u0662" for i in range(50)), f"{dotted}\n{prose(2, 'a')}\n{dotted}", f"{prose(1, 'a')}\n{dotted}\nList of figures\n{dotted}\n{prose(1, 'b')}", f"\u00a0\n{dotted}\n\u2028\n\x1c\n{numbered}\x85",
    ]
    rows = spark.createDataFrame([(i, x, f"src{i}") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["chunk_sidecar"](spark, str(tmp_path))
    found = df.collect()
    got, columns = rows_of(df.columns, found)
    names, want = duck_of(f"{tmp_path}/documents.parquet/*.parquet", registry.ORACLES["chunk_sidecar"])
    assert (got, columns) == rows_of(names, want)[:2]
    of = [sorted((r["parent_idx"], r["child_idx"], r["text"]) for r in found if r["doc_id"] == i) for i in range(len(texts))]
    assert not any(of[i] for i in (0, 1, 2, 3, 5, 6)) and all(of[i] for i in range(7, len(texts)))
    for i, parts in [(4, {"Part 0"}), (7, {prose(2, "a"), prose(5, "b")}), (8, {prose(4, "a")}), (9, {prose(6, "a")}), (14, {prose(2, "a")}), (15, {prose(1, "a"), prose(1, "b")})]:
        # no word of the prose is lost, none of the contents stays, and parents are numbered from 0
        assert {w for *_, x in of[i] for w in x.split("\n\n", 1)[1].split()} == {w for p in parts for w in p.split()}
        assert {p for p, *_ in of[i]} == set(range(1 + max(p for p, *_ in of[i])))


def duck_of(documents, sql):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def test_a_paper_counts_once_without_an_expansion_of_rows(spark):
    plan = registry.QUERIES["stage_recall"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_meta_tags_are_read_by_all_cores(spark):
    assert registry.QUERIES["meta_harvest"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_line_is_stripped_once(spark):
    from siltwork.functions import text as X

    plan = registry.QUERIES["clean_nav"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count(X.WIKI_EDIT) == 1
