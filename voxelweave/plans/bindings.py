"""Study-shaped views over the generic warehouse tables.

The study data is not distributed, so queries run on views of the given tables. Every view reads whole
tables; codes such as language or region are labels computed from ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelweave.functions.stats import index_by_id
from voxelweave.functions.vector import dot, doubles
from voxelweave.operators import design
from voxelweave.operators.attribution import FOLD
from voxelweave.operators.features import build_features, digest_encoder
from voxelweave.session import cut, spread

# Fixed values of the event timeline: origin, run length, and the study clock (450 event seconds = 1 study second).
ORIGIN = "2024-01-01 00:00:00"
RUN_MICROS = 5 * 86400 * 1_000_000
MICROS_PER_SECOND = 450 * 1_000_000
N_SCANS = 480
TRIPLETS_PER_RUN = 15  # Fixed value: size of the token subset of a run.
CLOCK = design.ScanClock(tr=2.0, fine_hz=10.0, kernel=tuple(design.glover_kernel(10.0)))
ENCODER_DIMS = 8

ROIS = (
    (0, "L_AG", "SEMANTIC"), (1, "R_AG", "SEMANTIC"), (2, "L_IFGtri", "SEMANTIC"),
    (3, "L_Heschl", "AUDITORY"), (4, "R_Heschl", "AUDITORY"), (5, "L_pSTG", "AUDITORY"),
)
# Region of each event type; roi_index is 1-based.
EVENT_ROIS = (
    ("click", 1, "L_AG", "SEMANTIC"), ("view", 2, "R_AG", "SEMANTIC"), ("signup", 3, "L_Heschl", "AUDITORY"),
    ("purchase", 4, "R_Heschl", "AUDITORY"), ("error", 5, "L_Precentral", "CONTROL"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(index: Column, *values) -> Column:
    """values[index] for a small non-negative index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def language_of(index: Column) -> Column:
    return choose(index % 3, "EN", "FR", "ZH")


# ---------------------------------------------------------------- results of a sweep, from lineitem

def subject_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("subject_id"),
        F.when(F.col("l_returnflag") == "A", "EN").when(F.col("l_returnflag") == "N", "FR").otherwise("ZH").alias("language"),
        F.when(F.col("l_linestatus") == "O", "xlmr").otherwise("nllb").alias("model"),
        (F.col("l_linenumber") % 2).cast("int").alias("block"),
        choose((F.floor(F.col("l_orderkey") / 2)) % 4, "ATTN", "POST_ATTN", "FFN", "OUTPUT").alias("state"),
        choose(F.col("l_orderkey") % 2, "SHARED", "SPECIFIC").alias("condition"),
        choose(F.col("l_partkey") % 6, *[r[1] for r in ROIS]).alias("roi"),
        choose(F.col("l_partkey") % 6, *[r[2] for r in ROIS]).alias("roi_family"),
        (F.lit(10.0) * F.col("l_discount") - F.lit(5.0) * F.col("l_tax")).alias("z"),
    )
    keys = ["subject_id", "language", "model", "block", "state", "condition", "roi", "roi_family"]
    return (
        rows.groupBy(*keys)
        .agg(F.avg("z").alias("z_mean"))
        .withColumn("block_depth_norm", F.col("block").cast("double"))
        .withColumn("r_mean", F.tanh("z_mean"))
    )


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outer-fold score per lineitem: setting, target (supplier), fold (line number), alpha, sums."""
    grid = [10.0 ** (-2 + 8 * i / 14) for i in range(15)]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model"),
        F.col("l_suppkey").alias("target_index"),
        F.col("l_linenumber").cast("bigint").alias("outer_run"),
        choose(F.col("l_partkey") % 15, *grid).alias("alpha"),
        (F.col("l_discount") - F.col("l_tax")).alias("fold_z"),
        F.col("l_quantity").alias("y_sum"),
        (F.col("l_quantity") * F.col("l_quantity") + F.col("l_discount")).alias("y_sq"),
        (F.col("l_tax") * F.col("l_quantity")).alias("sse"),
        F.lit(1.0).alias("n"),
        (F.col("l_partkey") % 20 + 1).alias("n_pcs"),
    )


# ---------------------------------------------------------------- manifests, from orders and lineitem

def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("subject_id"),
        choose(F.col("o_custkey") % 4, "en", "fr", "zh", "xx").alias("language"),
        F.col("o_orderpriority").alias("task_name"),
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("original_run_label"),
        (F.month("o_orderdate") % 9 + 1).cast("int").alias("canonical_run_index"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("n_volumes"),
        F.lit("MNI").alias("space"),
        F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/abs/").otherwise("rel/"), F.col("o_orderkey")).alias("filepath"),
        (F.col("o_orderstatus") == "F").alias("is_preproc"),
    )


def raw_rois(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.where(choose(F.col("o_custkey") % 4, "en", "fr", "zh", "xx") == language).select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("subject_id"),
        (F.month("o_orderdate") % 9 + 1).cast("int").alias("canonical_run_index"),
        F.concat(F.lit("roi/"), F.col("o_orderkey")).alias("filepath"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("n_scans"),
        F.lit(18).alias("n_rois"),
    )


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("section_index"),
        F.col("l_orderkey").alias("section_sentence_index"),
        F.col("l_partkey").alias("language_sentence_index"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
        F.col("l_quantity").alias("onset_sec"),
        (F.col("l_quantity") + F.col("l_tax")).alias("offset_sec"),
        F.col("l_tax").alias("duration_sec"),
        F.col("l_linenumber").alias("n_words"),
        F.col("l_suppkey").alias("first_word_idx"),
        (F.col("l_suppkey") + F.col("l_linenumber")).alias("last_word_idx"),
        F.col("l_discount").alias("alignment_cost"),
    )


def raw_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders")
    columns = []
    for i, lang in enumerate(("en", "fr", "zh")):
        columns += [
            F.concat(F.lit(f"{lang} "), F.col("o_orderpriority")).alias(f"{lang}_text"),
            (F.col("o_custkey") + i).alias(f"{lang}_first_sentence_idx"),
            (F.col("o_custkey") + i + F.col("o_orderkey") % 3).alias(f"{lang}_last_sentence_idx"),
            (F.col("o_totalprice") / 1000 + i).alias(f"{lang}_onset_sec"),
            (F.col("o_totalprice") / 1000 + i + 2).alias(f"{lang}_offset_sec"),
        ]
    return base.select(
        F.col("o_orderkey").alias("triplet_id"),
        (F.col("o_custkey") % 9 + 1).alias("section_index"),
        F.col("o_custkey").alias("section_triplet_index"),
        F.col("o_orderstatus").alias("merge_pattern"),
        *columns,
    )


def raw_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("triplet_id")).agg(
        (F.min("l_suppkey") % 9 + 1).alias("section_index"),
        (F.max("l_returnflag") == "R").alias("needs_manual_review"),
        F.when(F.min("l_linestatus") == "O", "approved").when(F.max("l_linestatus") == "F", "rejected").alias("manual_status"),
        F.when(F.max("l_discount") > 0.05, F.concat(F.lit("n"), F.count(F.lit(1)))).alias("notes"),
    )


def legacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("subject_id"),
        choose(F.col("l_orderkey") % 3, "en", "fr", "zh").alias("language"),
        F.when(F.col("l_linestatus") == "O", "xlmr").otherwise("nllb_encoder").alias("model"),
        choose(F.col("l_partkey") % 6, *[r[1] for r in ROIS]).alias("roi_name"),
        choose(F.col("l_partkey") % 6, *[r[2].lower() for r in ROIS]).alias("roi_family"),
        (F.col("l_linenumber") % 2).cast("int").alias("layer_index"),
        (F.col("l_linenumber") % 2).cast("double").alias("layer_depth"),
        choose(F.col("l_suppkey") % 6, "acoustic_only", "full", "mismatched_shared", "raw", "shared", "specific").alias("condition"),
        choose(F.col("l_linenumber") % 3, "r", "z", "r2").alias("metric_name"),
        F.col("l_discount").alias("v"),
    )
    keys = [c for c in rows.columns if c != "v"]
    return rows.groupBy(*keys).agg(F.avg("v").alias("value"))


def legacy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "xlmr").otherwise("nllb_encoder").alias("model"),
        choose(F.col("l_orderkey") % 3, "en", "fr", "zh").alias("language"),
        F.col("l_linenumber").cast("int").alias("layer_index"),
        choose(F.col("l_suppkey") % 6, "acoustic_only", "full", "mismatched_shared", "raw", "shared", "specific").alias("condition"),
        F.when(F.col("l_suppkey") % 6 == 2, F.col("l_partkey") % 20).alias("shuffle_index"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("n_rows")).withColumn("feature_dim", F.lit(64))


def legacy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older group table: means and the standard error over subjects of each metric."""
    def of(metric: str) -> Column:
        return F.when(F.col("metric_name") == metric, F.col("value"))

    keys = ["language", "model", "roi_name", "roi_family", "layer_index", "layer_depth", "condition"]
    return legacy_metrics(spark, sf_dir).groupBy(*keys).agg(
        *[F.avg(of(m)).alias(f"mean_{m}") for m in ("z", "r", "r2")],
        (F.stddev_samp(of("z")) / F.sqrt(F.count(of("z")))).alias("se_z"), F.count_distinct("subject_id").alias("n_subjects"),
    )


def output_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older list of stored output vectors: one row per model, language and layer."""
    layer = F.floor(F.col("vec_id") / 6) % 4
    rows = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 2 == 0, "xlmr").otherwise("nllb_encoder").alias("model"), choose(F.col("vec_id") % 3, "en", "fr", "zh").alias("language"),
        layer.cast("int").alias("layer_index"), (layer / F.lit(3.0)).alias("layer_depth"), F.size("embedding").alias("hidden_size"),
    )
    counted = rows.groupBy("model", "language", "layer_index", "layer_depth", "hidden_size").agg(F.count("*").alias("n_rows"))
    return counted.withColumn("dtype", F.lit("float32"))


# ---------------------------------------------------------------- vectors, from embeddings

def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    triplet = F.floor(F.col("vec_id") / 3)
    return table(spark, sf_dir, "embeddings").select(
        F.lit("m0").alias("model"),
        language_of(F.col("vec_id")).alias("language"),
        F.lit("OUTPUT").alias("state"),
        (triplet % 4).cast("int").alias("block"),
        ((triplet % 4) / F.lit(3.0)).alias("block_depth_norm"),
        triplet.cast("bigint").alias("triplet_row_index"),
        F.col("embedding").alias("vec"),
    )


# ---------------------------------------------------------------- timeline, from events

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    # Differences of local timestamps do not depend on the session time zone.
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{ORIGIN}', CAST(ts AS TIMESTAMP_NTZ))")
    return (
        raw.withColumn("_us", micros)
        .withColumn("canonical_run", (F.floor(F.col("_us") / F.lit(RUN_MICROS)) + 1).cast("int"))
        .withColumn("time_sec", (F.col("_us") % F.lit(RUN_MICROS)) / F.lit(float(MICROS_PER_SECOND)))
        .select("event_id", "user_id", "event_type", "value", "canonical_run", "time_sec", language_of(F.col("event_id")).alias("language"))
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_scans per (language, run): one row per observed run and language."""
    runs = events(spark, sf_dir).select("canonical_run").distinct()
    return runs.select(F.explode(F.array(*[F.lit(c) for c in ("EN", "FR", "ZH")])).alias("language"), "canonical_run", F.lit(N_SCANS).alias("n_scans"))


def sentence_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select(
        "language", "canonical_run", F.col("event_id").alias("triplet_row_index"),
        F.col("time_sec").alias("onset_sec"), (F.col("time_sec") + F.col("value") / F.lit(10.0)).alias("offset_sec"),
    )


def timed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind).select(
        "language", "canonical_run", "time_sec", F.col("time_sec").alias("onset_sec"),
        (F.col("value") / F.lit(10.0)).alias("duration_sec"), "value",
    )


def bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.col("user_id") % 24
    index = None
    for kind, roi, _, _ in EVENT_ROIS:
        index = F.when(F.col("event_type") == kind, roi) if index is None else index.when(F.col("event_type") == kind, roi)
    return (
        events(spark, sf_dir)
        .select(
            language_of(subject).alias("language"), F.concat(F.lit("U"), subject).alias("subject_id"), "canonical_run",
            F.floor(F.col("time_sec") / F.lit(CLOCK.tr)).cast("int").alias("scan"), index.alias("roi_index"), "value",
        )
        .groupBy("language", "subject_id", "canonical_run", "scan", "roi_index")
        .agg(F.sum("value").alias("value"))
    )


def roi_metadata(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("roi_index"), F.lit(n).alias("roi"), F.lit(f).alias("roi_family")) for _, i, n, f in EVENT_ROIS])
    return spark.range(1).select(F.inline(rows))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target columns of each language: (subject, region) numbered subject by subject."""
    people = spark.range(24).select(
        language_of(F.col("id")).alias("language"), F.concat(F.lit("U"), F.col("id")).alias("subject_id"), F.floor(F.col("id") / 3).alias("_p")
    )
    return people.join(roi_metadata(spark)).select(
        "language", "subject_id", "roi_index", "roi", "roi_family",
        (F.col("_p") * len(EVENT_ROIS) + F.col("roi_index") - 1).cast("bigint").alias("target_index"),
    )


def family_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family mean series on the dense scan grid (unobserved scans are 0), for every subject of a language."""
    everyone = targets(spark, sf_dir).groupBy("language", "subject_id", "roi_family").agg(F.count(F.lit(1)).alias("_n"))
    cells = bold(spark, sf_dir).join(roi_metadata(spark).select("roi_index", "roi_family"), "roi_index").groupBy(
        "language", "subject_id", "roi_family", "canonical_run", "scan"
    ).agg(F.sum("value").alias("_sum"))
    dense = design.scan_grid(scans(spark, sf_dir)).join(everyone, "language")
    return dense.join(cells, ["language", "subject_id", "roi_family", "canonical_run", "scan"], "left").select(
        "language", "subject_id", "roi_family", "canonical_run", "scan",
        F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0)).alias("value"),
    )


def sweep_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows of each block and condition, and ``places``: how many of them every block and language has. A timed sentence takes
    one feature row of each block and condition, in turn: row (id mod n_slots) of the block."""
    feats = build_features(state_vectors(spark, sf_dir), raw_states=()).select(
        "model", "state", "block", "condition", F.col("target_language").alias("language"), "triplet_row_index", "vec"
    )
    places = feats.where("condition = 'SPECIFIC'").groupBy("block", "language").agg(F.count(F.lit(1)).alias("n_slots"))
    return feats, places


def feature_of(triplet: Column) -> Column:
    """Row index of the feature that a sentence takes of a block: slots count a block's rows, of which there is one in four."""
    return triplet % F.col("n_slots") * 4 + F.col("block")


SWEEP_SETTING = ["model", "language", "block", "state", "condition"]


# ---------------------------------------------------------------- texts, from documents and conversations

def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sentences, one per line."""
    docs = table(spark, sf_dir, "documents")
    lang = F.upper("lang")
    return docs.select("doc_id", lang.alias("language"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def story_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive turns of the whole stream of turns as one aligned triplet with texts, run and timings."""
    keyed = table(spark, sf_dir, "conversations").withColumn("_id", F.col("conv_id") * 1000 + F.col("turn"))
    turns = index_by_id(keyed, "_id", "_n").withColumn("_t", F.floor(F.col("_n") / 3))
    slot = F.col("_n") % 3
    texts = [F.max(F.when(slot == i, F.col("text"))).alias(c) for i, c in enumerate(("en_text", "fr_text", "zh_text"))]
    complete = (
        turns.groupBy(F.col("_t").cast("bigint").alias("triplet_id")).agg(*texts)
        .where("en_text IS NOT NULL AND fr_text IS NOT NULL AND zh_text IS NOT NULL")
    )
    indexed = index_by_id(complete, "triplet_id")
    place = (F.floor(F.col("triplet_row_index") / 6) * 5 % 930).cast("double")
    timings = []
    for i, lang in enumerate(("en", "fr", "zh")):
        onset = place + F.lit(0.4 * i)
        timings += [onset.alias(f"{lang}_onset_sec"), (onset + F.length(f"{lang}_text") / F.lit(40.0)).alias(f"{lang}_offset_sec")]
    return indexed.select(
        "triplet_id", "triplet_row_index", (F.col("triplet_row_index") % 6 + 1).cast("int").alias("canonical_run"),
        "en_text", "fr_text", "zh_text", *timings,
    )


def by_language(triplets: DataFrame) -> DataFrame:
    """Triplets to one row per language: text, onset, offset."""
    parts = [
        F.struct(
            F.lit(lang.upper()).alias("language"), F.col(f"{lang}_text").alias("text"),
            F.col(f"{lang}_onset_sec").alias("onset_sec"), F.col(f"{lang}_offset_sec").alias("offset_sec"),
        )
        for lang in ("en", "fr", "zh")
    ]
    return triplets.select("triplet_id", "triplet_row_index", "canonical_run", F.inline(F.array(*parts)))


def piece_offsets(text: Column, width: int = 4) -> Column:
    """Fixed-width character pieces standing in for subwords, after one zero-width special token."""
    n = F.ceil(F.length(text) / F.lit(width)).cast("int")
    cuts = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(
        cuts, lambda i: F.struct((i * width).alias("start"), F.least((i + 1) * width, F.length(text)).alias("end"))
    )
    return F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), pieces)


def token_rows(sentences: DataFrame, keys: list[str], width: int = 4) -> DataFrame:
    """Token table of fixed-width pieces with an md5-based vector per token; the first token is special."""
    rows = spread(sentences, *keys).select(*keys, "text", F.posexplode(piece_offsets(F.col("text"), width)).alias("token_index", "_span"))
    token = F.substring("text", F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start"))
    digit = lambda i: (F.instr(F.lit("0123456789abcdef"), F.substring("_digits", i, 1)) - F.lit(8.5)) / F.lit(7.5)
    return (
        rows.withColumn("token", token)
        .withColumn("_h", F.md5("token")).withColumn("_digits", F.sha2("token", 256))
        .select(
            *keys, "text", "token_index", "token", F.conv(F.substring("_h", 1, 6), 16, 10).cast("int").alias("token_id"),
            F.col("_span.start").alias("start"), F.col("_span.end").alias("end"),
            F.lit(True).alias("attended"), (F.col("token_index") == 0).alias("special"),
            F.array(*[digit(i) for i in range(1, ENCODER_DIMS + 1)]).alias("vec"),
        )
    )


def story_states(story: DataFrame) -> DataFrame:
    """Encoded sentences of the story triplets; texts are spread first, as a stored story has few partitions."""
    sentences = by_language(spread(story, "triplet_row_index")).select("language", "triplet_row_index", "text")
    return digest_encoder(ENCODER_DIMS)(sentences).drop("text")


def story_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in fold models with exact SQL: the direction of run r is the mean of the embeddings with vec_id mod 6 = r - 1,
    all of whose components are averaged into those of the encoder."""
    means = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 6 + 1).cast("int").alias("canonical_run"), F.posexplode(doubles(F.col("embedding"))).alias("_d", "v")
    ).groupBy("canonical_run", (F.col("_d") % ENCODER_DIMS).alias("d")).agg(F.avg("v").alias("v"))
    w = means.groupBy("canonical_run").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("_w")).select(
        "canonical_run", F.col("_w.v").alias("w")
    )
    people = targets(spark, sf_dir).where("roi_family <> 'CONTROL'").select("language", "subject_id", "roi_family").distinct()
    return people.join(w).select(
        F.lit("m0").alias("model"), "language", F.lit(0).alias("block"), F.lit("OUTPUT").alias("state"),
        "roi_family", "subject_id", "canonical_run", "w",
    )


def story_series(spark: SparkSession, sf_dir: str, story: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Actual family series and the predictions of the stand-in models. ``story`` and ``states``: stored triplets and their encoded
    sentences, made here where the caller has none, so that texts are indexed and encoded once for all that reads them."""
    story = cut(story_triplets(spark, sf_dir)) if story is None else story
    basis = story_basis(spark, story)
    pooled = shared_story(story_states(story) if states is None else states)
    x = design.design_rows(basis, pooled, ["language"])
    models = story_models(spark, sf_dir)
    values = family_values(spark, sf_dir)
    rows = models.join(values, ["language", "subject_id", "roi_family", "canonical_run"]).join(
        x, ["language", "canonical_run", "scan"], "left"
    )
    predicted = F.coalesce(dot(F.col("x"), F.col("w")), F.lit(0.0))
    return rows.select(*FOLD, "scan", (F.col("value") / 100).alias("actual"), predicted.alias("predicted"))


def story_basis(spark: SparkSession, story: DataFrame) -> DataFrame:
    timing = by_language(story).select("language", "canonical_run", "triplet_row_index", "onset_sec", "offset_sec")
    return design.sentence_basis(timing, story_scans(spark), CLOCK)


def story_scans(spark: SparkSession) -> DataFrame:
    langs = F.explode(F.array(*[F.lit(c) for c in ("EN", "FR", "ZH")])).alias("language")
    return spark.range(1, 7).select(langs, F.col("id").cast("int").alias("canonical_run"), F.lit(N_SCANS).alias("n_scans"))


def shared_story(states: DataFrame) -> DataFrame:
    """Shared vectors of the story: the mean of the two other languages."""
    states = states.select(
        F.lit("m0").alias("model"), "language", F.lit("OUTPUT").alias("state"), F.lit(0).alias("block"),
        F.lit(0.0).alias("block_depth_norm"), "triplet_row_index", "vec",
    )
    return build_features(states, raw_states=()).where("condition = 'SHARED'").select(
        F.col("target_language").alias("language"), "triplet_row_index", "vec"
    )
