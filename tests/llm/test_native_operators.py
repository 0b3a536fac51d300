"""Operators with SQL: awkward rows against the SQL on the same rows, and cases made by hand."""

import duckdb
import pytest

from tests.llm.helpers import awkward, documents, frame, prose
from voxelweave.llm import decontamination as dc, licences, line_winnowing as lw, url_templates as ut


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return sorted(map(repr, con.execute(query).fetchall()))


def same(df, query, columns, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register("t_" + name, table.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM t_{name}")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({query})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


# ------------------------------------------------------------------ decontamination

def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination_equals_sql(spark):
    passage = prose("item", 30)
    rows = awkward() + [
        (20, prose(20, 40) + " " + passage + " " + prose(21, 40)), (21, passage.upper().replace(" ", " -- ")), (22, " ".join(passage.split()[:12])), (23, " ".join(passage.split()[4:17]) * 2),
        (24, "alpha beta gamma"), (25, "so alpha, BETA. it is"), (26, prose("x", 700) + " " + " ".join(passage.split()[:13])), (27, "É alpha é beta"), (28, "é alpha É beta"),
    ]
    bench = items(spark, [(1, passage), (10, passage), (2, "alpha beta"), (3, None), (4, "..."), (5, " ".join(passage.split()[5:20])), (6, "É alpha é beta"), (7, prose(4, 80))])
    df = documents(spark, rows, h=1, pos=2, words=3, n_words=4)
    same(dc.contamination(df, bench), dc.ORACLE_SQL, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], documents=df, benchmark=bench)
    assert 21 not in {r.doc_id for r in dc.uncontaminated(df, bench).collect()}


def test_contamination_without_items_or_rows(spark):
    df = documents(spark, awkward())
    assert {r.contaminated for r in dc.contamination(df, items(spark, [])).collect()} == {False}
    assert dc.contamination(documents(spark, []), items(spark, [(1, "a b")])).count() == 0
    kept = dc.uncontaminated(df, items(spark, []))
    assert kept.columns == df.columns and kept.count() == len(awkward())


def test_null_items_hit_but_are_not_listed(spark):
    got = dc.contamination(documents(spark, [(1, "x alpha beta y")]), items(spark, [(None, "alpha beta")])).first()
    assert (got.n_hit, got.n_items, got.contaminated) == (2, 0, True)


def test_capitals_whose_lower_case_depends_on_what_follows(spark):
    words = "ΕΣ.ΑΒ " + " ".join(f"w{i}" for i in range(12))
    df, bench = documents(spark, [(1, words), (2, "İ ΟΔΟΣ: " + words)]), items(spark, [(1, words)])
    got = same(dc.contamination(df, bench), dc.ORACLE_SQL, ["doc_id", "n_words", "n_hit", "contaminated"], documents=df, benchmark=bench)
    assert sorted(got) == [(1, 14, 14, True), (2, 16, 14, True)]


# ------------------------------------------------------------------ lines

def lines_of(spark, rows):
    from pyspark.sql import functions as F

    df = documents(spark, rows, line=1, h=2, content=3, lines=4)
    out = lw.deduplicate_lines(df).select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.md5("text").alias("text_md5"))
    return df, out


def test_lines_equal_sql(spark):
    rng = __import__("random").Random(4)
    pool = [prose(f"l{i}", rng.choice([1, 3, 10, 24, 26, 49, 50, 51, 70])) for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    df, out = lines_of(spark, rows + [(1000, None), (1001, ""), (1002, prose("alone", 20_000).replace(" amber", "\namber"))])
    got = same(out, lw.ORACLE_SQL, ["doc_id", "n_lines", "n_removed", "removed", "text_md5"], documents=df)
    assert sum(r[2] for r in got) > 100


def test_lines_by_hand(spark):
    a, b, c, d = prose("a", 20), prose("b", 20), prose("c", 20), prose("d", 60)
    rows = [(1, f"{a}\n{b}\n{c}\nend"), (2, f"x\n{a}\n\n{b} \n{c}\ny"), (3, f"{a}\n{b}"), (4, f"{d}\n{d}"), (5, None), (None, d), (6, "last"), (6, "last")]
    got = {(r.doc_id, r.text) for r in lw.deduplicate_lines(documents(spark, rows)).collect()}
    assert got == {(1, f"{a}\n{b}\n{c}\nend"), (2, "x\ny"), (3, f"{a}\n{b}"), (4, d), (5, None), (None, ""), (6, "last")}
    assert lw.deduplicate_lines(documents(spark, [])).count() == 0


def test_repeated_rows_are_one_text(spark):
    text = prose("r", 70)
    assert [r.text for r in lw.deduplicate_lines(documents(spark, [(3, text), (3, text), (2, "x")])).where("doc_id = 3").collect()] == [text, text]


# ------------------------------------------------------------------ licences

def test_licences_equal_sql(spark):
    texts = list(licences.TEMPLATES.values())
    rows = awkward() + [(30 + i, prose(i, 30) + "\n" + t + "\n" + prose(-i, 20)) for i, t in enumerate(texts)]
    rows += [(60 + i, " ".join(t.split()[: max(2, len(t.split()) * 4 // 5)])) for i, t in enumerate(texts)]
    rows += [(90, "released under the mit license RELEASED UNDER THE MIT LICENSE all rights reserved"), (91, "under the license, version 2"), (92, texts[1].replace("software", "work"))]
    df = documents(spark, rows, size=1, h=2, licence=3, words=4)
    got = same(licences.scan(df), licences.oracle_sql(), ["doc_id", "n_licences", "licences", "spans", "best_score"], documents=df)
    by_id = {r[0]: r for r in got}
    assert by_id[30][2] == "Apache-2.0" and all(by_id[30 + i][1] >= 1 for i in range(len(texts))) and by_id[4][1] == 0


def test_every_notice_of_a_text_is_found(spark):
    header, short, mit = licences.TEMPLATES["Apache-2.0-header"], licences.TEMPLATES["Apache-2.0"], licences.TEMPLATES["MIT"]
    text = " ".join([header, prose(1, 30), short, prose(2, 30), header, mit, mit])
    df = documents(spark, [(1, text)])
    (row,) = same(licences.scan(df), licences.oracle_sql(), ["doc_id", "n_licences", "licences", "spans", "best_score"], documents=df)
    assert row[2] == "Apache-2.0-header,Apache-2.0,Apache-2.0-header,MIT,MIT" and row[4] == 1


def test_no_templates_no_matches(spark):
    df = documents(spark, awkward())
    assert {r.n_licences for r in licences.scan(df, {"one": "word"}).collect()} == {0}
    assert licences.scan(documents(spark, [])).count() == 0


# ------------------------------------------------------------------ urls

URLS = [
    "http://A.Example.NET/en/12", "https://example.com/de/x?y", "https://example.com/de", "ftp://x.org/fr/", "no scheme", None, "http://net/", "http://net", "http://fakenet/a", "x://y://z/q",
    "http://h.org/a/b/c/d/e/f?q#r", "http://h.org#frag/a", "http://É.com/Ü/1", "http://spam.com/deal/77", "http://spam.com/deal/78.html", "http://spam.com/news/1",
]


def pages(spark, n=400):
    rows = [(i, URLS[i // 2 % len(URLS)] if i % 2 else f"http://spam.com/{'deal' if i % 4 else 'news'}/{i}") for i in range(n)]
    rows += [(10_000 + i, f"http://wide.com/{chr(97 + i)}x/p") for i in range(25)] + [(None, "http://spam.com/deal/1"), (3, "http://spam.com/deal/2"), (3, "http://spam.com/deal/2")]
    return spark.createDataFrame([(*r, "<p>", "clash", 1) for r in rows], "page_id long, url string, html string, host string, labelled int")


def test_urls_equal_sql(spark):
    df = pages(spark)
    labels = spark.createDataFrame([(i, 0 if i % 2 == 0 and i % 4 else 1) for i in range(300)] + [(5, 0), (None, 0), (6, None)], "doc_id long, quality int")
    got = same(ut.judge(df, labels), ut.oracle_sql(), ["page_id", "host", "path", "rule", "verdict", "template", "good_share"], pages=df, labels=labels)
    verdict = {(r[1], r[2]): r for r in got}
    assert verdict[("a.example.net", "/en/12")][3:5] == ("example.net/en/", "allow") and verdict[("example.com", "/de/x")][3:5] == ("example.com/de/", "block")
    assert verdict[("example.com", "/de")][3] is None and verdict[("", "")][4] == "allow" and verdict[("net", "/")][3:5] == ("net/", "block") and verdict[("fakenet", "/a")][3] is None
    assert verdict[("spam.com", "/deal/77")][4] == "block" and verdict[("spam.com", "/news/1")][4] == "allow"
    assert {r[5] for r in got if r[1] == "wide.com"} == {"/**"}  # without labels nothing is told apart


def labelled_pages(spark, paths):
    """(pages, labels) from (path, pages, whether they are good)."""
    rows, marks = [], []
    for where, n, good in paths:
        for _ in range(n):
            rows.append((len(rows), f"http://h.com{where}/{len(rows)}"))
            marks.append((len(marks), int(good)))
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int")


@pytest.mark.parametrize("sections", [16, 40])
def test_a_bad_section_stands_out_whatever_the_number_of_its_siblings(spark, sections):
    named = [f"/{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(sections)]
    df, labels = labelled_pages(spark, [(w, 60, w != named[3]) for w in named])
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "good_share"]
    got = same(ut.judge(df, labels), ut.oracle_sql(), columns, pages=df, labels=labels)
    assert {r[2].rpartition("/")[0] for r in got if r[4] == "block"} == {named[3]}
    assert {r[5] for r in got} == {named[3] + "/*", "/*/*"}


def test_branches_below_many_segments_and_alike_ones_are_judged_together(spark):
    deep = "/a/b/c/d/e/f/g"
    df, labels = labelled_pages(spark, [(deep + "/good", 60, True), (deep + "/evil", 60, False), ("/x", 40, False), ("/y", 40, False), *[(f"/ok/{chr(97 + i)}", 30, True) for i in range(20)]])
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "good_share"]
    got = same(ut.judge(df, labels), ut.oracle_sql(levels=12), columns, pages=df, labels=labels)
    blocked = {r[2].rpartition("/")[0] for r in got if r[4] == "block"}
    assert blocked == {deep + "/evil", "/x", "/y"}
    where = {r[2].rpartition("/")[0]: r[5] for r in got}
    assert where["/x"] == where["/y"] and where["/ok/a"] == where["/ok/t"] and where[deep + "/good"] != where[deep + "/evil"]
    with pytest.raises(Exception, match="more levels"):
        same(ut.judge(df, labels), ut.oracle_sql(), columns, pages=df, labels=labels)


def test_fewer_labels_than_eleven_never_tell_children_apart():
    a, z, told = 10.0, 1.96, []
    for n in range(2, 12):
        for child in range(1, n):
            for bad in range(n + 1):
                for b in range(max(0, bad - n + child), min(child, bad) + 1):
                    for prior in (i / 50 for i in range(51)):
                        usual = (bad + a * prior) / (n + a)
                        gap = abs((b + a * usual) / (child + a) - (bad - b + a * usual) / (n - child + a))
                        mean = (bad + 2 * a * usual) / (n + 2 * a)
                        error = (mean * (1 - mean) * (1 / (child + a) + 1 / (n - child + a))) ** 0.5
                        if error > 0 and gap >= z * error:
                            told.append(n)
    assert not told or min(told) == 11


def test_urls_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.verdict for r in ut.judge(pages(spark), none).where("rule is null").collect()} == {"allow"}
    assert ut.judge(pages(spark).limit(0), none).count() == 0
