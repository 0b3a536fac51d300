"""Deletion validation: top-k words against matched random words, scored on held-out runs."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxelweave.functions.stats import fisher_z, hash_int, pearson_from_sums
from voxelweave.functions.text import delete_spans
from voxelweave.functions.vector import doubles, minus
from voxelweave.operators.attribution import FOLD, SETTING
from voxelweave.operators.features import Encoder
from voxelweave.session import cut, spread

SUBJECT = [*SETTING, "roi_family", "subject_id"]
GROUP = [*SUBJECT, "triplet_row_index"]
SCANS_PER_BLOCK = 512
SENTENCES_AT_ONCE = 1024  # bounds the matrices of a block
WORD = ["sentence_language", "word_index", "word_char_start", "word_char_end"]

# Policy labels, in the order they are tried.
EXACT = "exact_language_token_class_no_overlap"
LANGUAGE_APART = "language_allocation_nonpunct_no_overlap"
LANGUAGE_ANY = "language_allocation_nonpunct_overlap_allowed"
TOTAL_APART = "total_count_nonpunct_no_overlap"
TOTAL_ANY = "total_count_any_overlap_allowed"
REUSED = "fallback_topk_reused"
POLICIES = (EXACT, LANGUAGE_APART, LANGUAGE_ANY, TOTAL_APART, TOTAL_ANY, REUSED)


def rank_words(attributions: DataFrame, group: Sequence[str] = GROUP, decimals: int = 10) -> DataFrame:
    """Rank words of a sentence: score descending, then language, start and word index."""
    order = Window.partitionBy(*group).orderBy(
        F.round("attribution_score", decimals).desc(), "sentence_language", "word_char_start", "word_index"
    )
    return attributions.withColumn("score_rank", F.row_number().over(order))


def top_words(attributions: DataFrame, k: int, group: Sequence[str] = GROUP) -> DataFrame:
    return rank_words(attributions, group).where(F.col("score_rank") <= k)


def matching_plan(ranked: DataFrame, ks: Sequence[int], group: Sequence[str] = GROUP) -> DataFrame:
    """For every k: which words are selected, the matching policy, and who may be drawn from which cell.

    A policy is feasible when each cell of the selection finds as many words in the pool. Counts are
    windows below (group, k), which the layout of the ranks serves; a group is one sentence.
    """
    rows = ranked.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    key = [*group, "k"]
    by_class, by_language, whole = (
        Window.partitionBy(*key, "sentence_language", "token_class"),
        Window.partitionBy(*key, "sentence_language"),
        Window.partitionBy(*key),
    )
    selected = F.col("score_rank") <= F.col("k")
    spoken = F.col("token_class") != "PUNCT"

    def count(condition: Column, window) -> Column:
        return F.sum(condition.cast("int")).over(window)

    rows = rows.withColumn("selected", selected).withColumns(
        {
            "_need_class": count(selected, by_class),
            "_pool_class": count(~selected, by_class),
        }
    )
    rows = rows.withColumns(
        {
            "_need_language": count(selected, by_language),
            "_pool_language": count(~selected, by_language),
            "_spoken_pool_language": count(~selected & spoken, by_language),
            "_spoken_language": count(spoken, by_language),
        }
    )
    # Cells nobody needs are trivially met: the pool count is never below zero.
    rows = rows.withColumns(
        {
            "_need_total": count(selected, whole),
            "_pool_total": count(~selected, whole),
            "_spoken_pool_total": count(~selected & spoken, whole),
            "_all_total": F.count(F.lit(1)).over(whole),
            "_class_ok": F.min((F.col("_pool_class") >= F.col("_need_class")).cast("int")).over(whole),
            "_language_ok": F.min((F.col("_pool_language") >= F.col("_need_language")).cast("int")).over(whole),
        }
    )
    return _eligible(rows.withColumn("policy", _policy()))


def _policy() -> Column:
    return (
        F.when(F.col("_class_ok") == 1, EXACT)
        .when(F.col("_language_ok") == 1, LANGUAGE_APART)
        .when(F.col("_need_total") <= F.col("_all_total"), LANGUAGE_ANY)
        .otherwise(REUSED)
    )


def matching_counts(ranked: DataFrame, ks: Sequence[int], group: Sequence[str] = GROUP) -> DataFrame:
    """The matching plan by counts: for every k, language and token class the number ``n_words`` of selected and of other words, with
    policy, cell, need and eligibility. Words are counted once for all k; the plan is made of the counts."""
    kind = ["sentence_language", "token_class"]
    taken = [F.sum((F.col("score_rank") <= int(k)).cast("bigint")).alias(f"_taken_{k}") for k in ks]
    counts = ranked.groupBy(*group, *kind).agg(F.count(F.lit(1)).alias("_n"), *taken)
    by_k = F.inline(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"_taken_{k}").alias("_need_class")) for k in ks]))
    cells = counts.select(*group, *kind, "_n", by_k)
    language, whole = Window.partitionBy(*group, "k", "sentence_language"), Window.partitionBy(*group, "k")
    need, pool, spoken = F.col("_need_class"), F.col("_n") - F.col("_need_class"), F.col("token_class") != "PUNCT"
    total = lambda value, over: F.sum(value).over(over)
    said = lambda value: F.when(spoken, value).otherwise(F.lit(0))
    cells = cells.withColumns(
        {
            "_need_language": total(need, language), "_pool_language": total(pool, language),
            "_spoken_pool_language": total(said(pool), language), "_spoken_language": total(said(F.col("_n")), language),
        }
    )
    cells = cells.withColumns(
        {
            "_need_total": total(need, whole), "_spoken_pool_total": total(said(pool), whole), "_all_total": total(F.col("_n"), whole),
            "_class_ok": F.min((pool >= need).cast("int")).over(whole),
            "_language_ok": F.min((F.col("_pool_language") >= F.col("_need_language")).cast("int")).over(whole),
        }
    )
    sides = F.inline(F.array(F.struct(F.lit(True).alias("selected"), need.alias("n_words")), F.struct(F.lit(False).alias("selected"), pool.alias("n_words"))))
    rows = cells.withColumn("policy", _policy()).select("*", sides).where("n_words > 0")
    return _eligible(rows)


def _eligible(rows: DataFrame) -> DataFrame:
    apart = ~F.col("selected")
    spoken = F.col("token_class") != "PUNCT"
    need_language, need_total = F.col("_need_language"), F.col("_need_total")
    language_apart = apart & (spoken | (F.col("_spoken_pool_language") < need_language))
    language_any = spoken | (F.col("_spoken_language") < need_language)
    total_apart = apart & (spoken | (F.col("_spoken_pool_total") < need_total))
    policy = F.col("policy")
    eligible = (
        F.when(policy == EXACT, apart)
        .when(policy == LANGUAGE_APART, language_apart)
        .when(policy == LANGUAGE_ANY, language_any)
        .when(policy == TOTAL_APART, total_apart)
        .when(policy == TOTAL_ANY, F.lit(True))
        .otherwise(F.col("selected"))
    )
    by_language = policy.isin(LANGUAGE_APART, LANGUAGE_ANY)
    need = F.when(policy == EXACT, F.col("_need_class")).when(by_language, need_language).otherwise(need_total)
    cell = (
        F.when(policy == EXACT, F.concat_ws("|", "sentence_language", "token_class"))
        .when(by_language, F.col("sentence_language"))
        .otherwise(F.lit("all"))
    )
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*kept, eligible.alias("eligible"), need.alias("need"), cell.alias("cell"))


def total_count_plan(ranked: DataFrame, k: int, group: Sequence[str] = GROUP, *, prefer_apart: bool = True) -> DataFrame:
    """Matching on the number of words alone: unselected spoken words when there are enough of them, then any
    unselected words, then any word, and as the last resort the selection itself."""
    whole = Window.partitionBy(*group)
    selected = F.col("score_rank") <= k
    spoken = F.col("token_class") != "PUNCT"
    rows = ranked.withColumns({"k": F.lit(k), "selected": selected}).withColumns(
        {
            "_need_total": F.sum(selected.cast("int")).over(whole),
            "_pool_total": F.sum((~selected).cast("int")).over(whole),
            "_spoken_pool_total": F.sum((~selected & spoken).cast("int")).over(whole),
            "_all_total": F.count(F.lit(1)).over(whole),
            "_need_class": F.lit(0), "_need_language": F.lit(0), "_spoken_pool_language": F.lit(0), "_spoken_language": F.lit(0),
        }
    )
    need = F.col("_need_total")
    policy = (
        F.when(F.lit(prefer_apart) & (F.col("_pool_total") >= need), TOTAL_APART)
        .when(F.col("_all_total") >= need, TOTAL_ANY)
        .otherwise(REUSED)
    )
    return _eligible(rows.withColumn("policy", policy))


def drawn_positions(n: Column, need: Column, number: Callable[[Column], Column]) -> Column:
    """Sorted positions (from 0) of ``need`` draws without replacement out of ``n``; the i-th draw takes the (number(i) mod (n - i))-th
    position that is still free."""

    def take(taken: Column, i: Column) -> Column:
        free = F.pmod(number(i), n - i)
        at = F.aggregate(taken, free, lambda place, t: F.when(place >= t, place + 1).otherwise(place))
        return F.array_sort(F.concat(taken, F.array(at)))

    turns = F.sequence(F.lit(0).cast("bigint"), F.least(need, n) - 1)
    return F.aggregate(turns, F.array().cast("array<bigint>"), take)


def narrow(plan: DataFrame) -> DataFrame:
    """What the texts of the draws need."""
    return plan.select(*GROUP, "canonical_run", "k", "cell", "need", "eligible", *WORD)


def sample_words(plan: DataFrame, draws: int, seed: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Sampling without replacement: ``need`` of the eligible words of each (group, k, cell), for every draw.

    The words of a cell, those of one sentence at most, become one row in order; a draw hashes once for each word it takes,
    so the work grows with the words drawn and not with words times draws. All columns of ``plan`` come along: select before.
    """
    key = [*group, "k", "cell"]
    rest = [c for c in plan.columns if c not in (*key, *WORD, "need", "eligible")]
    cells = plan.where(F.col("eligible") & (F.col("need") > 0)).groupBy(*key).agg(
        F.max("need").cast("bigint").alias("_need"), F.array_sort(F.collect_list(F.struct(*WORD, *rest))).alias("_words")
    )
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*group, "k", "draw", "cell"]])
    places = drawn_positions(F.size("_words").cast("bigint"), F.col("_need"), lambda i: hash_int(text, i, digits=15))
    taken = drawn.select(*key, "draw", "_words", F.explode(places).alias("_place"))
    word = F.get("_words", F.col("_place").cast("int"))
    return taken.select(*key, "draw", *[word[c].alias(c) for c in (*WORD, *rest)])


SPAN = "struct<start:int,end:int>"
LANES = "ks:array<int>,draws:array<int>,at:array<int>"


def ranked_sentences(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per setting and sentence: its words, ranked for each subject. ``wanted``: (subject keys, k) cells to be scored."""
    subject_words = ranked.groupBy(*GROUP, "canonical_run").agg(F.collect_list(F.struct(*WORD, "token_class", "score_rank")).alias("words"))
    ks = wanted.groupBy(*SUBJECT).agg(F.array_sort(F.collect_set(F.col("k").cast("int"))).alias("ks"))
    people = F.collect_list(F.struct("roi_family", "subject_id", "ks", "words"))
    return subject_words.join(F.broadcast(ks), SUBJECT).groupBy(*SETTING, "triplet_row_index", "canonical_run").agg(people.alias("people"))


def cells_of(words: list[tuple], ranks: list[int], k: int) -> tuple[str, list[tuple[str, int, list[int]]]]:
    """Policy of one sentence, and (cell, need, positions of the eligible words) of what is drawn; ``matching_plan`` for one (group, k).
    ``words``: (language, word columns.., token class) in order."""
    kinds, spoken = [(w[0], w[-1]) for w in words], [w[-1] not in (None, "PUNCT") for w in words]
    languages, chosen = [w[0] for w in words], [r <= k for r in ranks]
    need, need_language = Counter(c for c, s in zip(kinds, chosen) if s), Counter(c for c, s in zip(languages, chosen) if s)
    every, every_language = Counter(kinds), Counter(languages)
    if all(every[c] >= 2 * n for c, n in need.items()):
        return EXACT, _dealt([not s for s in chosen], ["|".join(v for v in c if v is not None) for c in kinds], [need[c] for c in kinds])
    needs = [need_language[c] for c in languages]
    if all(every_language[c] >= 2 * n for c, n in need_language.items()):
        pool = Counter(c for c, s, said in zip(languages, chosen, spoken) if said and not s)
        return LANGUAGE_APART, _dealt([not s and (said or pool[c] < n) for c, s, said, n in zip(languages, chosen, spoken, needs)], languages, needs)
    pool = Counter(c for c, said in zip(languages, spoken) if said)
    return LANGUAGE_ANY, _dealt([said or pool[c] < n for c, said, n in zip(languages, spoken, needs)], languages, needs)


def _dealt(eligible: list[bool], cells: list[str], needs: list[int]) -> list[tuple[str, int, list[int]]]:
    found: dict[str, tuple[int, list]] = {}
    for i, (free, cell, need) in enumerate(zip(eligible, cells, needs)):
        if free and need > 0:
            found.setdefault(cell, (need, []))[1].append(i)
    return [(cell, need, places) for cell, (need, places) in found.items()]


def picked(head: bytes, draw: int, cell: str, n: int, need: int) -> list[int]:
    """``drawn_positions`` of one draw."""
    taken: list[int] = []
    for i in range(min(need, n)):
        place = int(hashlib.md5(b"%b|%d|%b|%d" % (head, draw, cell.encode(), i)).hexdigest()[:15], 16) % (n - i)
        for t in taken:
            place += place >= t
        bisect.insort(taken, place)
    return taken


def sentence_draws(sentences: DataFrame, draws: int, seed: int) -> DataFrame:
    """The texts that a sentence is needed in (``requests``: each language and set of spans once), and for each subject the policies
    and the lanes: which request (``at``) is read by which k and draw, -1 for the selection itself. Draws are those of ``sample_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select(keys).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([drawn(row, one.column("people").flatten())], schema=shape)

    def drawn(row: dict, people: pa.StructArray) -> dict:
        setting, requests, out = [row[c] for c in SETTING], {}, []
        families, subjects, wanted = (people.field(c).to_pylist() for c in ("roi_family", "subject_id", "ks"))
        for i, (family, subject, person_ks) in enumerate(zip(families, subjects, wanted)):
            columns = people.field("words").slice(i, 1).flatten().flatten()  # word columns, token class, rank
            listed = sorted(zip(*[c.to_pylist() for c in columns]), key=lambda w: ((w[0] or "").encode(), *w[1:4]))
            words, ranks = [w[:-1] for w in listed], [w[-1] for w in listed]
            lanes, policies, alone = [], [], {}

            def ask(k: int, draw: int, places: list[int]) -> None:
                if len(places) == 1:
                    at = alone.get(places[0])
                    if at is None:
                        w = words[places[0]]
                        at = alone[places[0]] = requests.setdefault((w[0], (w[2:4],)), len(requests))
                    lanes.append((k, draw, at))
                    return
                some = [words[p] for p in places]
                for language in {w[0] for w in some}:
                    spans = tuple(sorted(w[2:4] for w in some if w[0] == language))
                    lanes.append((k, draw, requests.setdefault((language, spans), len(requests))))

            group = [seed, *setting, family, subject, row["triplet_row_index"]]
            for k in person_ks:
                ask(k, -1, [p for p, r in enumerate(ranks) if r <= k])
                policy, cells = cells_of(words, ranks, k)
                policies.append(policy)
                head = "|".join(str(v) for v in [*group, k] if v is not None).encode()
                for draw in range(draws):
                    ask(k, draw, [pool[i] for cell, need, pool in cells for i in picked(head, draw, cell, len(pool), need)])
            ks, numbers, places = map(list, zip(*lanes)) if lanes else ([], [], [])
            out.append({"roi_family": family, "subject_id": subject, "wanted": person_ks, "policies": policies, "ks": ks, "draws": numbers, "at": places})
        asked = [{"sentence_language": c, "spans": [{"start": a, "end": b} for a, b in spans]} for c, spans in requests]
        return row | {"requests": asked, "people": out}

    types = dict(sentences.dtypes)
    keys = [*SETTING, "triplet_row_index", "canonical_run"]
    people = f"array<struct<roi_family:string,subject_id:string,wanted:array<int>,policies:array<string>,{LANES}>>"
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], f"requests array<struct<sentence_language:string,spans:array<{SPAN}>>>", f"people {people}"])
    shape = to_arrow_schema(StructType.fromDDL(schema))
    return sentences.select(*keys, "people").mapInArrow(run, schema)


def request_changes(asked: DataFrame, texts: DataFrame, states: DataFrame, encoder: Encoder) -> DataFrame:
    """Half the change of the source vector for every distinct (sentence, spans). Only spans are shuffled: texts are made and
    encoded beside their sentence, once for each set of spans."""
    sentence = ["sentence_language", "triplet_row_index"]
    requests = asked.select("triplet_row_index", F.inline("requests")).distinct()
    stored = states.select(F.col("language").alias("sentence_language"), "triplet_row_index", doubles(F.col("vec")).alias("_stored"))
    rows = spread(requests, *sentence).join(texts.select(*sentence, "text"), sentence).join(stored, sentence)
    mutated = delete_spans(F.col("text"), F.col("spans"), F.col("sentence_language"))
    encoded = encoder(rows.select(F.col("sentence_language").alias("language"), "triplet_row_index", "spans", "_stored", mutated.alias("text")))
    change = F.transform(minus(doubles(F.col("vec")), F.col("_stored")), lambda x: x / F.lit(2.0))
    return encoded.select(F.col("language").alias("sentence_language"), "triplet_row_index", "spans", change.alias("delta"))


def lane_gains(asked: DataFrame, changes: DataFrame, models: DataFrame) -> DataFrame:
    """Rows (fold keys, triplet_row_index, ks, draws, gs): what each lane adds to the prediction per unit of weight."""
    keys = [*SETTING, "triplet_row_index", "canonical_run"]
    each = changes.groupBy("triplet_row_index").agg(F.collect_list(F.struct("sentence_language", "spans", "delta")).alias("changes"))
    weights = models.groupBy(*SETTING, "canonical_run").agg(F.collect_list(F.struct("roi_family", "subject_id", "w")).alias("weights"))
    rows = asked.join(each, "triplet_row_index").join(weights, [*SETTING, "canonical_run"]).select(*keys, "requests", "people", "changes", "weights")
    name = lambda r: (r["sentence_language"], tuple((s["start"], s["end"]) for s in r["spans"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select([*keys, "requests", "changes", "weights"]).to_pylist()[0]
                people = one.column("people").flatten()
                lists = {c: people.field(c) for c in ("ks", "draws", "at")}
                delta = {name(c): c["delta"] for c in row["changes"]}
                known = np.array([name(r) in delta for r in row["requests"]])
                if not known.any():
                    continue
                width = len(next(iter(delta.values())))
                moved = np.array([delta.get(name(r), [0.0] * width) for r in row["requests"]], np.float64)
                found = []
                w = {(m["roi_family"], m["subject_id"]): np.array(m["w"], np.float64) for m in row["weights"]}
                for i, who in enumerate(zip(people.field("roi_family").to_pylist(), people.field("subject_id").to_pylist())):
                    k, draw, places = (lists[c][i].values.to_numpy() for c in ("ks", "draws", "at"))
                    here = known[places]
                    if who not in w or not here.any():
                        continue
                    code, lane = np.unique((k[here].astype(np.int64) << 32) + draw[here] + 1, return_inverse=True)
                    g = np.bincount(lane, (moved @ w[who])[places[here]], len(code))
                    head = {c: row[c] for c in keys} | dict(zip(("roi_family", "subject_id"), who))
                    found.append(head | {"ks": code >> 32, "draws": (code & 0xFFFFFFFF) - 1, "gs": g})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=shape)

    types = dict(asked.dtypes)
    named = [f"`{c}` {types.get(c, 'string')}" for c in [*FOLD, "triplet_row_index"]]
    schema = ", ".join([*named, "ks array<int>", "draws array<int>", "gs array<double>"])
    shape = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def fold_sums(series: DataFrame) -> DataFrame:
    """Sums behind the held-out correlation of every fold."""
    a, p = F.col("actual"), F.col("predicted")
    return series.groupBy(*FOLD).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(p).alias("sp"),
        F.sum(a * a).alias("saa"), F.sum(p * p).alias("spp"), F.sum(a * p).alias("sap"),
    )


def _run_z(sp: Column, spp: Column, sap: Column) -> Column:
    return fisher_z(pearson_from_sums(F.col("n"), F.col("sa"), sp, F.col("saa"), spp, sap))


def base_scores(sums: DataFrame) -> DataFrame:
    """Mean Fisher z over the folds of each subject and setting."""
    return sums.groupBy(*SUBJECT).agg(F.avg(_run_z(F.col("sp"), F.col("spp"), F.col("sap"))).alias("base_z"))


def _block_corrections(key: tuple, changed: pd.DataFrame, scans: pd.DataFrame) -> pd.DataFrame:
    """Corrections to the sums of one fold by one block of scans, for all its (k, draw) lanes at once; zeros where the lanes reach no scan."""
    if changed.empty:
        return pd.DataFrame(columns=[*FOLD, "k", "draw", "dp", "dpp", "dap"])
    flat = lambda part, c, kind: np.concatenate([np.asarray(v, kind) for v in part[c]])
    number = lambda part: (flat(part, "ks", np.int64) << 32) + flat(part, "draws", np.int64) + 1
    code = np.unique(number(changed))
    lanes = np.stack([code >> 32, (code & 0xFFFFFFFF) - 1])
    out = dict(zip(FOLD, key)) | {"k": lanes[0], "draw": lanes[1]} | {c: np.zeros(len(code)) for c in ("dp", "dpp", "dap")}
    if "met" in changed:
        met: dict[int, int] = {}
        for k, bit in zip(flat(changed, "wanted", np.int64).tolist(), flat(changed, "met", np.int64).tolist()):
            met[k] = met.get(k, 0) | bit
        out["met"] = np.array([met.get(k, 0) for k in lanes[0].tolist()], np.int32)
    if scans.empty or pd.isna(key[-1]):
        return pd.DataFrame(out)
    places, change = pd.Index(scans["scan"]), np.zeros((len(scans), len(code)))
    for first in range(0, len(changed), SENTENCES_AT_ONCE):
        part = changed.iloc[first : first + SENTENCES_AT_ONCE]
        sentences = np.arange(len(part))
        gain = np.zeros((len(part), len(code)))
        np.add.at(gain, (np.repeat(sentences, part["ks"].map(len)), np.searchsorted(code, number(part))), flat(part, "gs", float))
        place, weight = places.get_indexer(flat(part, "scans", np.int64)), np.zeros((len(scans), len(part)))
        here = place >= 0
        np.add.at(weight, (place[here], np.repeat(sentences, part["scans"].map(len))[here]), flat(part, "weights", float)[here])
        change += weight @ gain
    p, a = scans["predicted"].to_numpy(), scans["actual"].to_numpy()
    out |= {"dp": change.sum(0), "dpp": 2 * (p @ change) + (change * change).sum(0), "dap": a @ change}
    return pd.DataFrame(out)


def lane_corrections(lanes: DataFrame, basis: DataFrame, series: DataFrame) -> DataFrame:
    """Corrections to the sums of every fold by each (k, draw), stored, for the sentences listed in ``lanes`` (fold keys, triplet_row_index,
    ks, draws, gs). With ``wanted`` (ks) and ``met`` (bits of ``POLICIES``) also the policies that each k met.

    Draws are lanes: a sentence is one row with its gains, a task holds one block of ``SCANS_PER_BLOCK`` scans of one fold with the
    sentences that reach it, and all draws move its scans in one matrix product. What leaves are corrections to the fold
    sums, so there is no row for each draw and scan.
    """
    block = F.floor(F.col("scan") / SCANS_PER_BLOCK).alias("block_of_scans")
    reach = basis.groupBy("language", "canonical_run", "triplet_row_index", block).agg(F.collect_list(F.struct("scan", "weight")).alias("_reach"))
    reach = reach.select(
        "language", "canonical_run", "triplet_row_index", "block_of_scans", F.col("_reach.scan").alias("scans"), F.col("_reach.weight").alias("weights")
    )
    told = [c for c in ("wanted", "met") if c in lanes.columns]
    # Sentences that reach no scan go along, so the corrections tell which lanes there are and the lanes are read once.
    moved = lanes.select(*FOLD, "triplet_row_index", "ks", "draws", "gs", *told).where(F.size("ks") > 0)
    changed = moved.join(reach, ["language", "canonical_run", "triplet_row_index"], "left").drop("triplet_row_index")
    # New attributes: lanes and series may descend from the same models, and a cogroup cannot tell their columns apart.
    moved_scans = series.select(*[F.col(c).alias(c) for c in FOLD], "scan", "predicted", "actual", block)
    types = dict(series.select(*FOLD).dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in FOLD], "k int", "draw int", "dp double", "dpp double", "dap double", *(["met int"] if told else [])])
    tasks = [*FOLD, "block_of_scans"]
    parts = changed.groupBy(*tasks).cogroup(moved_scans.groupBy(*tasks)).applyInPandas(_block_corrections, schema)
    sums = [F.sum(c).alias(c) for c in ("dp", "dpp", "dap")]
    return cut(parts.groupBy(*FOLD, "k", "draw").agg(*sums, *([F.bit_or("met").alias("met")] if told else [])))


def mutated_scores(corrections: DataFrame, sums: DataFrame) -> DataFrame:
    """Mean Fisher z of every (k, draw) from the corrections to the fold sums; runs without a change keep their base score."""
    wanted = corrections.select(*SUBJECT, "k", "draw").distinct().join(sums, SUBJECT)
    zero = F.lit(0.0)
    moved = wanted.join(corrections, [*FOLD, "k", "draw"], "left")
    z = _run_z(
        F.col("sp") + F.coalesce("dp", zero), F.col("spp") + F.coalesce("dpp", zero), F.col("sap") + F.coalesce("dap", zero)
    )
    return moved.groupBy(*SUBJECT, "k", "draw").agg(F.avg(z).alias("z"))


def deletion_rows(
    attributions: DataFrame, *, models: DataFrame, series: DataFrame, basis: DataFrame, texts: DataFrame, states: DataFrame,
    encoder: Encoder, ks: Sequence[int], draws: int, seed: int, pending: DataFrame | None = None,
) -> DataFrame:
    """delta_topk, delta_random and delta_diff per subject, setting and k.

    ``pending`` limits the work to the listed (subject keys, k) cells. ``attributions`` are rows of words, or packed sentences, whose
    lanes are made in their row.
    """
    sums = fold_sums(series)
    if "people" in attributions.columns:
        from voxelweave.operators import packed

        corrections = lane_corrections(packed.lane_gains(attributions, pending, encoder, ks, draws, seed), basis, series)
        met = corrections.groupBy(*SUBJECT, "k").agg(F.bit_or("met").alias("_met"))
        named = F.filter(F.array(*[F.when(F.getbit("_met", F.lit(i)) == 1, p) for i, p in enumerate(POLICIES)]), lambda p: p.isNotNull())
        return _summary(mutated_scores(corrections, sums), sums, met.select(*SUBJECT, "k", F.array_join(F.array_sort(named), "+").alias("matching_policy")))
    sentence = [*SETTING, "triplet_row_index"]
    rows = spread(attributions.select(*GROUP, "canonical_run", *WORD, "token_class", "attribution_score"), *sentence)
    if pending is None:
        pending = rows.select(*SUBJECT).distinct().withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    wanted = pending.where(F.col("k").isin([int(k) for k in ks])).select(*SUBJECT, "k").distinct()
    asked = cut(sentence_draws(ranked_sentences(rank_words(rows), wanted), draws, seed))  # read for the texts, the lanes and the policies
    scores = mutated_scores(lane_corrections(lane_gains(asked, request_changes(asked, texts, states, encoder), models), basis, series), sums)
    each = asked.select(*SETTING, F.inline("people")).select(*SUBJECT, F.inline(F.arrays_zip(F.col("wanted").alias("k"), F.col("policies").alias("policy"))))
    policies = each.toDF(*SUBJECT, "k", "policy").groupBy(*SUBJECT, "k").agg(
        F.array_join(F.array_sort(F.collect_set("policy")), "+").alias("matching_policy")
    )
    return _summary(scores, sums, policies)


def _summary(scores: DataFrame, sums: DataFrame, policies: DataFrame) -> DataFrame:
    random = F.col("draw") >= 0
    summary = scores.groupBy(*SUBJECT, "k").agg(
        F.max(F.when(~random, F.col("z"))).alias("topk_z"),
        F.avg(F.when(random, F.col("z"))).alias("random_z_mean"),
        F.count(F.when(random, 1)).cast("int").alias("n_random_draws"),
    )
    rows = summary.join(base_scores(sums), SUBJECT).join(policies, [*SUBJECT, "k"])
    top_drop, random_drop = F.col("base_z") - F.col("topk_z"), F.col("base_z") - F.col("random_z_mean")
    return rows.select(
        "subject_id", "model", "language", "roi_family",
        F.col("block").alias("representative_block"), F.col("state").alias("representative_state"),
        "k", "base_z", "topk_z", "random_z_mean",
        top_drop.alias("delta_topk"), random_drop.alias("delta_random"), (top_drop - random_drop).alias("delta_diff"),
        "n_random_draws", "matching_policy",
    )


def last_rows(rows: DataFrame, written: str) -> DataFrame:
    """Of several rows of a (setting, subject, k) the one written last wins, by map-side maxima."""
    keys = ["subject_id", "model", "language", "roi_family", "representative_block", "representative_state", "k"]
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.struct(written, *[c for c in rest if c != written])
    return rows.groupBy(*keys).agg(F.max(ordered).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns])


def policy_counts(plan: DataFrame) -> DataFrame:
    """How many sentences of each setting and k were matched under each policy; ``plan``: words or counts."""
    sentences = plan.where("selected").select(*GROUP, "k", "policy").distinct()
    keys = [c for c in GROUP if c not in ("subject_id", "triplet_row_index")]
    return sentences.groupBy(*keys, "k", "policy").agg(F.count(F.lit(1)).alias("n_sentences"))


def adaptive_subjects(rows: DataFrame, min_gain: float = 0.0) -> DataFrame:
    """Subjects whose k = 2 difference beats k = 1 by more than ``min_gain``: they go on to k = 3.

    Without a k = 2 row there is no third round; a missing k = 1 row counts as 0.
    """
    keys = ["subject_id", "model", "language", "roi_family", "representative_block", "representative_state"]
    pairs = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("k") == 1, F.col("delta_diff"))).alias("_one"),
        F.max(F.when(F.col("k") == 2, F.col("delta_diff"))).alias("_two"),
    )
    return pairs.where(F.col("_two").isNotNull() & (F.col("_two") - F.coalesce("_one", F.lit(0.0)) > min_gain)).select(
        *[F.col(k) for k in keys]
    )


def subject_grid(rows: DataFrame, k: int) -> DataFrame:
    return rows.select(
        "model", "language", F.col("representative_block").alias("block"), F.col("representative_state").alias("state"),
        "roi_family", "subject_id", F.lit(int(k)).alias("k"),
    )
