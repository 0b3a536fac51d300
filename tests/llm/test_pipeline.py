"""The pipeline's run() against plain Python on a small corpus, stage by stage, each on its own input."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, documents, prose
from tests.llm.test_classifiers import labelled
from tests.llm.test_near_copies import edited, plain_kept_rows
from tests.llm.test_simhash_vptree import plain_fingerprint
from voxelweave.llm import mixing, toxicity
from voxelweave.llm.common import stored

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = prose("bench", 40)
    rows = [(1000 + i, t, "en", f"s{i % 5}" if i % 3 else "hot", len(t)) for i, (t, _) in enumerate(labelled(150))]
    rows += [(d, t, "en", "odd" if d != 8 else None, 0) for d, t in awkward()]
    rows += [(2000 + i, prose("copy", 70) + (" end" if i % 2 else ""), "en", "hot", 0) for i in range(6)] + [(2100, prose("c", 30) + " " + passage, "en", "hot", 0)]
    for g in range(8):  # similar sets, far fingerprints
        base = prose(f"between{g}", 70)
        rows += [(2300 + 2 * g, base, "en", "hot", 0), (2301 + 2 * g, edited(base, 1, random.Random(g)), "en", "hot", 0)]
    documents(spark, rows, segment=1, size=2).write.parquet(f"{folder}/documents.parquet")
    labels = [(1000 + i, 1, int(y)) for i, (_, y) in enumerate(labelled(150))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def near_duplicates_gone(rows):
    """The smallest (doc_id, text) of each component by brute-force Jaccard; rows without an id stay."""
    given = sorted({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None})
    kept = set(plain_kept_rows(given))
    once = Counter((r.doc_id, r.text) for r in set(rows) if r.doc_id is not None and (r.doc_id, r.text or "") in kept)
    return once + counted(r for r in rows if r.doc_id is None)


def plain_contaminated(text, items):
    words, hit = plain_words(text), set()
    for item in filter(None, map(plain_words, items)):
        n = min(13, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def counted(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], sf_dir), name))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [s.collect() for s in steps]

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = counted(r for r in rows[0] if model.score([r.text])[0] < 0.7)
    assert counted(rows[1]) == want and len(rows[1]) < len(rows[0])

    want = near_duplicates_gone(rows[1])
    assert counted(rows[2]) == want
    texts, kept = {r.doc_id: r.text for r in rows[1]}, {r.doc_id for r in rows[2]}
    both = [(d, d + 1) for d in range(2300, 2316, 2) if d in texts and d + 1 in texts]
    far = [(a, b) for a, b in both if bin(plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).count("1") > 4]
    assert far and all(a in kept and b not in kept for a, b in far)  # a rule of 4 bits would keep both

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = counted(r for r in rows[2] if not plain_contaminated(r.text, items))
    assert counted(rows[3]) == want and 2100 in {r.doc_id for r in rows[2]} and 2100 not in {r.doc_id for r in rows[3]}

    con = duckdb.connect()
    con.register("given", steps[3].toArrow())
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    times = {d: taken // size if size else 1 for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall() if d is not None}
    want = Counter()
    for r in rows[3]:
        want[(r.doc_id, r.text)] += times.get(r.doc_id, 1)
    assert counted(rows[4]) == +want

    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    ids = {(r.doc_id, r.text): tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows[4]}
    want = Counter((r.doc_id, len(i := ids[(r.doc_id, r.text)]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows[4])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows[5]) == want
    for r in sorted(rows[5], key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, rows[5]))


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "token_files"])
def test_stages_hand_texts_to_workers_in_bounded_batches(spark, sf_dir, name):
    """A partition of 8 MB of texts is not one Arrow batch, as it is by Spark's own bounds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        texts = spark.range(0, 4_000, 1, 1).selectExpr("id", "repeat('text ', 400) as text")

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

        rows = [r.rows for r in texts.mapInArrow(run, "rows long").collect()]
        assert sum(rows) == 4_000 and max(rows) * 2_000 <= 2 << 20
    finally:
        spark.conf.set(key, before)


def test_workers_keep_no_chunks_after_the_files_are_read(spark, sf_dir):
    """Python workers outlive the stage; what they remember of its texts does not."""
    docs, parts = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")  # more tasks than workers, so that each takes part in the reading
    try:
        assert corpus_pipeline.write_tokens(spark, docs, sf_dir).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)

    def run(batches):
        from voxelweave.llm import token_files

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array([token_files.encoder.cache_info().currsize], pa.int64())})

    held = [r.held for r in spark.range(0, 24, 1, 24).mapInArrow(run, "held long").collect()]
    assert len(held) == 24 and not any(held)
