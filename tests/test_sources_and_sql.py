"""The document source, Atom files, SQL functions and the chunking table function."""

import os

import pytest
from pyspark.sql import functions as F

from siltwork.functions import sql as S
from siltwork.functions import text as X
from siltwork.operators import section_chunks as C
from siltwork.sources import readers
from siltwork.sources.document_tree import TreeReader, read_tree, write_tree


@pytest.fixture
def tree(tmp_path):
    files = {"a/one.txt": "first\n", "a/b/two.txt": "zwei é", "a/_admin/no.txt": "hidden", "_x/no.txt": "hidden", "c/three.md": "# md", "c/empty.txt": "", ".git/no.txt": "hidden"}
    for name, text in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "tree")


def test_tree_has_a_row_for_each_document(spark, tree):
    rows = {r.path: (r.size, r.text) for r in read_tree(spark, tree).collect()}
    assert rows == {"a/one.txt": (6, "first\n"), "a/b/two.txt": (7, "zwei é"), "c/three.md": (4, "# md"), "c/empty.txt": (0, "")}
    assert {r.path for r in read_tree(spark, f"file://{tree}", pattern="*.md").collect()} == {"c/three.md"}
    assert read_tree(spark, tree, pattern="*.none").count() == 0


def test_filters_are_applied_while_planning(spark, tree):
    files = read_tree(spark, tree)
    assert [r.path for r in files.filter(F.col("path").startswith("a/b")).collect()] == ["a/b/two.txt"]
    assert {r.path for r in files.filter("path in ('a/one.txt', 'c/empty.txt', 'none')").collect()} == {"a/one.txt", "c/empty.txt"}
    assert {r.path for r in files.filter("size <= 4 and path like '%t%'").collect()} == {"c/three.md", "c/empty.txt"}
    from pyspark.sql.datasource import GreaterThan, StringStartsWith

    reader = TreeReader({"path": tree, "per_task": "1"})
    rest = list(reader.pushFilters([StringStartsWith(("path",), "a/"), GreaterThan(("size",), 1)]))
    assert len(rest) == 1 and [f for p in reader.partitions() for f, _ in p.files] == ["a/b/two.txt", "a/one.txt"]
    assert len(TreeReader({"path": tree, "per_task": "1"}).partitions()) == 4


def test_too_large_files_are_an_error_or_skipped(spark, tree):
    with pytest.raises(Exception, match="at most 6"):
        read_tree(spark, tree, max_bytes=6).collect()
    assert "a/b/two.txt" not in {r.path for r in read_tree(spark, tree, max_bytes=6, on_large="skip").collect()}


def test_texts_are_written_as_files_by_their_tasks(spark, tmp_path):
    texts = ["zwei é\n", "", None, "a\x1eb", "x" * 70_000]
    rows = [(f"source={'ab'[i % 2]}/c%2Fd", texts[i % 5]) for i in range(60)] + [("_admin", "hidden")]
    for _ in range(2):  # a second job adds its files
        write_tree(spark.createDataFrame(rows, "folder string, text string").repartition(5), f"file://{tmp_path}/out")
    found = read_tree(spark, f"file://{tmp_path}/out", pattern="part-*").collect()
    assert sorted((r.path.rsplit("/", 2)[0], r.text) for r in found) == sorted((f, t or "") for f, t in rows[:-1] * 2)
    assert all(r.size == len(r.text.encode()) for r in found)
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["_admin", "source=a", "source=b"]  # nothing staged is left
    assert not [f for _, _, names in os.walk(tmp_path / "out") for f in names if not f.startswith("part-")]  # no checksum beside each file
    kept = [r.path for r in read_tree(spark, f"{tmp_path}/out").filter(~F.col("path").startswith("source=a/")).collect()]
    assert len(kept) == 60 and all(p.startswith("source=b/") for p in kept)


def test_files_are_ruled_out_by_a_negated_filter_while_planning(tree):
    from pyspark.sql.datasource import Not, StringStartsWith

    reader = TreeReader({"path": tree, "per_task": "1"})
    assert not list(reader.pushFilters([Not(StringStartsWith(("path",), "a/"))]))
    assert [f for p in reader.partitions() for f, _ in p.files] == ["c/empty.txt", "c/three.md"]


def test_doc_scan_knows_any_source(spark, tmp_path):
    """Names that a path must not hold, the empty one and none; the job's own table has other columns too."""
    from siltwork.plans import registry

    registry.load()
    sources = ["a/b", "", "web", "web2", None, "ü =%2F", "..", "src1"]
    rows = [(i, f"é{i}", sources[i % 8]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, text, source in rows:
        if source not in ("web", None):
            files, size = want.get(source, (0, 0))
            want[source] = (files + 1, size + len(text.encode()))
    assert {r.source: (r.files, r.bytes) for r in registry.QUERIES["doc_scan"](spark, str(tmp_path)).collect()} == want


def test_atom_entries_are_rows(spark, tmp_path):
    feed = """<?xml version="1.0"?><feed><title>All</title><entry><id>u1</id><title>A &amp; B
 two lines</title><published>2024-01-01</published><author><name>Roe</name></author><author><name>Bauer</name></author></entry><entry><id>u2</id></entry></feed>"""
    (tmp_path / "feed.xml").write_text(feed)
    rows = {r.id: (r.title, r.published, r.authors) for r in readers.read_atom(spark, str(tmp_path / "feed.xml")).collect()}
    assert rows["u1"][1:] == ("2024-01-01", ["Roe", "Bauer"]) and rows["u1"][0].split() == ["A", "&", "B", "two", "lines"]
    assert rows["u2"] == (None, None, None)


# --- SQL functions ---


def test_every_text_function_is_callable_from_sql(spark):
    names = S.register_functions(spark)
    assert len(names) > 30 and {"cited_indices", "site_name", "author_line", "slug", "fail_signature", "section_chunks"} <= set(names)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.createOrReplaceTempView("docs_of_sql")
    values = {"INT": "2001", "DOUBLE": "0.5", "ARRAY<STRING>": "split(substring(text, 1, 60), ' ')", "ARRAY<ARRAY<STRING>>": "array(array('k', substring(text, 1, 9)))", "STRING": "substring(text, 1, 3000)"}
    wanted, asked = [], []
    for name, (parameters, f) in S.scalar_functions().items():
        kinds = [S.TYPES.get(p, "STRING") for p in parameters]
        asked.append(f"{name}({', '.join(values[k] for k in kinds)}) AS {name}")
        wanted.append(f(*(F.expr(values[k]).cast(k.lower()) for k in kinds)).alias(name))
    made = spark.sql(f"SELECT doc_id, {', '.join(asked)} FROM docs_of_sql")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    own = docs.select("doc_id", *wanted)
    assert sorted(map(str, made.collect())) == sorted(map(str, own.collect()))


def test_operators_in_strings_stay(spark):
    assert S.quoted_calls("and(=(x, 'a=(b) and(c)'), !(in(y, '\\'or(')))") == "`and`(`=`(x, 'a=(b) and(c)'), `!`(`in`(y, '\\'or(')))"
    S.register_functions(spark, "silt_")
    assert spark.sql("SELECT silt_cited_indices('x [1][2] y_[3]') AS v").first().v == [1, 2]


# --- chunking ---


def chunk(rows, limits=None):
    c = C.SectionChunks()
    if limits:
        c.limits = limits
    names = ("doc", "pos", "section", "role", "breadcrumb", "type", "text", "caption", "summary")
    out = [r for row in rows for r in c.eval(dict(zip(names, row)))]
    return [*out, *c.terminate()]


def text(section, role, body, pos=0):
    return (1, pos, section, role, role.title(), "text", body, None, None)


@pytest.mark.parametrize("role", [*C.PROFILES, "unknown"])
def test_each_role_has_its_budgets(role):
    parent, child, overlap = C.PROFILES.get(role, C.PROFILES["body"])
    words = [f"w{i}" for i in range(1900)]
    paragraphs = [" ".join(words[i : i + 190]) for i in range(0, 1900, 190)]
    out = chunk([text(1, role, p, i) for i, p in enumerate(paragraphs)])
    by = {}
    for _, p, i, r, b, kind, t in out:
        assert r == role and kind == "text" and t.startswith(f"[{role.title()}]\n\n")
        by.setdefault(p, []).append(t.split("\n\n", 1)[1].split())
    per = parent // 190 * 190
    assert sorted(by) == list(range(-(-1900 // per)))
    for p, parts in by.items():
        own = words[p * per : (p + 1) * per]
        assert parts[0] == own[: len(parts[0])] and all(len(x) <= child + C.SHORT_CHILD for x in parts)
        for a, b in zip(parts, parts[1:]):
            assert b[:overlap] == a[len(a) - overlap :] if overlap else not set(a) & set(b)
        assert set(own) == {w for x in parts for w in x}


def test_roles_are_dropped_and_short_children_join():
    out = chunk([text(1, "references", "x " * 100), text(2, "body", "y " * 40), text(3, "body", "z " * 600), text(4, "toc", "q " * 90)])
    assert {r[3] for r in out} == {"body"} and all("y" not in r[6].split() for r in out)  # 40 words are too few
    assert len(out) == 1 and out[0][6].count("z") == 600 + 50  # the last 138 words join the 512 before, which they overlap


def test_characters_close_a_child():
    parts = C.children("longword" * 3 + " " + "a " * 50 + "b" * 500, 1000, 2, 60)
    assert all(len(p) <= 60 for p in parts[:-1]) and parts[-1].endswith("b" * 500)
    assert C.children("", 5, 2, 60) == [] and C.children("a b c d e", 2, 1, 99) == ["a b", "b c", "c d", "d e"]


def test_tables_stand_for_themselves():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'x' * 20} |" for i in range(40))
    row = lambda summary, caption="Table 2: T": (1, 1, 1, "results", "Results", "table", table, caption, summary)
    with_summary = chunk([text(1, "results", "w " * 60), row("short"), text(1, "results", "v " * 60, 2)])
    assert [(r[1], r[2], r[5]) for r in with_summary] == [(0, 0, "text"), (1, None, "table"), (1, 0, "table"), (2, 0, "text")]
    assert with_summary[2][6] == "[Results]\n\nshort" and table in with_summary[1][6]
    whole = chunk([row(None)])
    assert [(r[1], r[2]) for r in whole] == [(0, None)] and whole[0][6] == f"[Results]\n\nTable 2: T\n\n{table}"
    cut = chunk([row("s" * 900)], limits=(500, 1, 1))
    assert len(cut) > 2 and [r[1] for r in cut] == list(range(len(cut))) and all(len(r[6]) <= 500 for r in cut)
    assert "(part 1/" in cut[0][6] and "(continued — see Table 2 above) (part 2/" in cut[1][6]
    assert sum(r[6].count("x" * 20) for r in cut) == 40 and all(r[6].count("| a | b |") == 1 for r in cut)
    assert chunk([(1, 1, 1, "results", "R", "table", "no table", None, None)]) == []
    assert chunk([(1, 1, None, None, None, "text", None, None, None)]) == []


def test_chunks_of_a_frame_are_made_by_document(spark):
    rows = []
    for doc in (1, 2, None):
        rows += [(doc, 0, "heading", "Title", 1, None, None), (doc, 1, "heading", "Methods", 2, None, None), (doc, 2, "text", f"m{doc} " * 80, 0, None, None), (doc, 3, "heading", "References", 2, None, None), (doc, 4, "text", "r " * 80, 0, None, None)]
    e = spark.createDataFrame(rows, "doc long, pos long, type string, text string, text_level int, caption string, summary string").repartition(7)
    role = F.when(F.col("heading") == "Methods", "method").otherwise("references")
    out = C.chunks(e, role).collect()
    assert {(r.doc, r.parent_idx, r.child_idx, r.role, r.breadcrumb) for r in out} == {(d, 0, 0, "method", "Methods") for d in (1, 2, None)}


def test_section_chunks_from_sql(spark):
    S.register_functions(spark)
    spark.createDataFrame([(1, 1, 0, "body", "B", "text", "w " * 60, None, None), (1, 0, 0, "body", "B", "text", "first", None, None)], "doc long, pos long, section long, role string, breadcrumb string, type string, text string, caption string, summary string").createOrReplaceTempView("parts_of_doc")
    out = spark.sql("SELECT * FROM section_chunks(TABLE(parts_of_doc) PARTITION BY doc ORDER BY pos)").collect()
    assert len(out) == 1 and out[0].text.startswith("[B]\n\nfirst w w")
