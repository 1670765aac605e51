"""Relational operators: filters (P*), joins (J*), aggregates (A*), windows (W*),
sorts/sets (O*, U*) and the incremental-work joins (S10, S11).

Joins against the fixed dimensions are broadcast (their size is fixed by
``tulkki.dims``); joins between data-sized inputs are plain equi-joins that
Spark plans as shuffle joins, with AQE free to re-plan them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tulkki import dims
from tulkki.functions import text as tx
from tulkki.operators.tables import small
from tulkki.schemas import KNOWN_COLUMNS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- P: projections, filters, predicates -----------------------------------

def asr_model_applies(model: Column, lang: Column) -> Column:
    """A language-bound ``wav2vec2`` model applies only to its own language."""
    return ~model.contains("wav2vec2") | model.endswith(lang)


def applicable_asr(df: DataFrame, models: DataFrame, lang_col: str = "lang") -> DataFrame:
    """P1 as a join: rows x ASR models that apply to the row's language."""
    return df.join(models, asr_model_applies(models["asr_model"], df[lang_col]), "inner")


def mt_model_applies(model: Column, src: Column, tgt: Column) -> Column:
    """Model name contains ``{src}_{tgt}`` or starts with ``nllb``."""
    return model.contains(F.concat_ws("_", src, tgt)) | model.startswith("nllb")


def applicable_mt(df: DataFrame, models: DataFrame, src_col: str = "src_lang",
                  tgt_col: str = "tgt_lang") -> DataFrame:
    """P2 as a join against the (broadcast) MT model registry."""
    return df.join(models, mt_model_applies(models["mt_model"], df[src_col], df[tgt_col]), "inner")


def valid_text(col, error_marker: str | None = dims.ERROR_MARKER) -> Column:
    """Text present, non-empty and (optionally) free of an error marker."""
    c = _c(col)
    ok = c.isNotNull() & (F.length(tx.strip(c)) > 0)
    if error_marker:
        ok = ok & ~c.contains(error_marker)
    return ok


def known_language(col, langs=None) -> Column:
    """Language membership."""
    return _c(col).isin(*(langs or dims.LANGUAGES))


def effective_line_index(parsed_index, n_ref_lines) -> Column:
    """P5: a single-line reference forces index 0."""
    return F.when(_c(n_ref_lines) == 1, F.lit(0).cast("bigint")).otherwise(_c(parsed_index).cast("bigint"))


def line_index_ok(index, n_ref_lines) -> Column:
    """P5: index within [0, number of reference lines)."""
    i = _c(index)
    return (i >= 0) & (i < _c(n_ref_lines))


def split_rejects(df: DataFrame, reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    return df.filter(F.col(reason_col).isNull()).drop(reason_col), df.filter(F.col(reason_col).isNotNull())


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The first failing check names the reject reason (NULL = accepted)."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(checks):
        out = F.when(cond, F.lit(reason)).otherwise(out)
    return out


def order_columns(df: DataFrame, known=KNOWN_COLUMNS) -> DataFrame:
    """Known summary columns first (in their order), the rest after."""
    first = [c for c in known if c in df.columns]
    rest = [c for c in df.columns if c not in first]
    return df.select(*first, *rest)


def with_task(df: DataFrame, task: str) -> DataFrame:
    """P8."""
    return df.withColumn("Task", F.lit(task))


def only(df: DataFrame, col: str, value) -> DataFrame:
    """P10: a single-file run is the same job filtered to one key."""
    return df.filter(F.col(col) == F.lit(value))


# --- J: joins ----------------------------------------------------------------

def align_by_position(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos",
                      how: str = "inner") -> DataFrame:
    """Zip two line lists on (key, pos); inner join = cut to the shorter list."""
    return left.join(right, [*keys, pos], how)


def count_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """J1 flag: per key the two list lengths and whether they differ."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    return (a.join(b, keys, "full")
             .select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"),
                     F.coalesce("n_right", F.lit(0)).alias("n_right"))
             .withColumn("count_mismatch", F.col("n_left") != F.col("n_right")))


def with_condition(df: DataFrame, conditions: DataFrame, code_col: str = "Condition_Code") -> DataFrame:
    """Left join to the condition dimension (broadcast, being small)."""
    c = conditions.withColumnRenamed("Condition_Code", "__code")
    return (df.join(small(c), df[code_col] == c["__code"], "left").drop("__code"))


def with_mt_model(df: DataFrame, pairs: DataFrame, src_col="src_lang", tgt_col="tgt_lang") -> DataFrame:
    """Opus model by (src, tgt); unsupported pair -> reject reason."""
    p = pairs.withColumnRenamed("src_lang", "__s").withColumnRenamed("tgt_lang", "__t")
    out = df.join(small(p), (df[src_col] == p["__s"]) & (df[tgt_col] == p["__t"]), "left")
    return (out.withColumn("pair_reject", F.when(F.col("opus_model").isNull(), F.lit("unsupported_pair")))
               .drop("__s", "__t"))


def with_code(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str) -> DataFrame:
    """Code lookup defaulting to the key itself."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(value).alias("__v"))
    return (df.join(small(d), df[key] == d["__k"], "left")
              .withColumn(out, F.coalesce(F.col("__v"), df[key])).drop("__k", "__v"))


def language_pairs(langs: DataFrame, col: str = "lang") -> DataFrame:
    """All ordered pairs of distinct languages (a dimension-sized cross product)."""
    a = langs.select(F.col(col).alias("src_lang"))
    b = langs.select(F.col(col).alias("tgt_lang"))
    return a.crossJoin(b).filter(F.col("src_lang") != F.col("tgt_lang"))


def fan_out(df: DataFrame, langs: list[str], lang_col: str = "lang") -> DataFrame:
    """Each row x each other declared language, in the row (no join)."""
    others = F.filter(F.array(*[F.lit(x) for x in langs]), lambda x: x != F.col(lang_col))
    return df.withColumn("tgt_lang", F.explode(others))


def with_reference(pred: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction rows joined to their reference (left, so missing refs are seen)."""
    return pred.join(refs, keys, "left")


def with_asr_quality(mt: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """MT rows joined to the quality of their ASR source.

    Human-source rows (no ASR model) get the fixed literals of a human source.
    """
    q = quality.select(*keys, *[F.col(c).alias(f"__q_{c}") for c in quality.columns if c not in keys])
    out = mt.join(q, keys, "left")
    human = F.col(keys[-1]).isNull()
    for c in [c for c in quality.columns if c not in keys]:
        lit = F.lit(0.0) if c in ("WER", "WIL", "High_WER_Percentage") else F.lit(-1).cast("bigint") if c == "Line_Index" else F.lit("N/A")
        if c == "Audio_File_Name":
            lit = F.lit(dims.HUMAN_SOURCE)
        out = out.withColumn(c, F.when(human, lit).otherwise(F.col(f"__q_{c}"))).drop(f"__q_{c}")
    return out


# --- A: aggregates --------------------------------------------------------------

def join_lines(df: DataFrame, keys: list[str], pos: str = "pos", text: str = "text",
               out: str = "text") -> DataFrame:
    """A1: ordered concatenation of a file's lines into one text."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias(out))


def join_stretches(df: DataFrame, keys: list[str], pos: str = "pos", text: str = "text", stretch: int = 1 << 20, block: int = 10_000) -> DataFrame:
    """A1 for files of any size: keys, stretch (from 0) and ``text``.

    A stretch has the lines, joined by a blank, whose first character lies in
    its ``stretch`` characters of the joined text, so that no row is longer
    than that and a line; a file's stretches in order are its text.  Lengths
    are first summed by blocks of ``block`` positions, whose starts follow
    from a row a block, then within each block: a file of any number of lines
    is spread over tasks.  Null texts are left out, as ``join_lines`` does;
    positions are unique in a file and 0 at least.
    """
    size = F.char_length("_text") + 1
    rows = df.select(*keys, F.col(pos).alias("_pos"), F.col(text).alias("_text"), F.floor(F.col(pos) / block).alias("_block")).where("_text IS NOT NULL")
    # null keys are keys here
    key = F.struct(*keys)
    rows = rows.withColumn("_key", key)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("_key", "_block").agg(F.sum(size).alias("_size"))
              .select("_key", "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")))
    within = Window.partitionBy("_key", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum(size).over(within), F.lit(0))).join(starts, ["_key", "_block"])
    number = F.floor((F.col("_start") + F.col("_at")) / stretch).alias("stretch")
    lines = F.array_sort(F.collect_list(F.struct("_pos", "_text")))
    return (placed.select("_key", number, "_pos", "_text").groupBy("_key", "stretch")
            .agg(F.array_join(F.transform(lines, lambda x: x["_text"]), " ").alias(text))
            .select(*[F.col("_key")[k].alias(k) for k in keys], "stretch", text))


def quality_report(df: DataFrame, keys: list[str], threshold: float = dims.HIGH_WER_THRESHOLD,
                   accepted: Column | None = None) -> DataFrame:
    """A2/A3: mean WER, mean WIL (missing skipped) and the share with WER > threshold.

    The share is a fraction in [0, 1]; rows with missing WER stay in its
    denominator.  ``accepted`` restricts the rows inside the aggregate (instead
    of a filter that Catalyst would push into, and recompute in, the inputs).
    Partial aggregation runs map-side, so a hot key costs one small row per
    map task in the shuffle.
    """
    ok = F.lit(True) if accepted is None else accepted
    n = F.count_if(ok)
    return df.groupBy(*keys).agg(
        F.avg(F.when(ok, F.col("WER"))).alias("mean_wer"),
        F.avg(F.when(ok, F.col("WIL"))).alias("mean_wil"),
        F.when(n > 0, F.count_if(ok & (F.col("WER") > threshold)) / n).alias("high_wer_share"),
        n.alias("n_files"),
    )


def corpus_wer(df: DataFrame, keys: list[str], counts: str = "al") -> DataFrame:
    """A4: micro WER/WIL: sums of hits/subs/dels/ins first, ratio last."""
    a = F.col(counts)
    g = df.groupBy(*keys).agg(
        F.sum(a["hits"]).alias("H"), F.sum(a["subs"]).alias("S"),
        F.sum(a["dels"]).alias("D"), F.sum(a["ins"]).alias("I"))
    n_ref = F.col("H") + F.col("S") + F.col("D")
    n_hyp = F.col("H") + F.col("S") + F.col("I")
    return g.select(*keys,
                    F.when(n_ref > 0, (F.col("S") + F.col("D") + F.col("I")) / n_ref).alias("corpus_wer"),
                    F.when(n_ref > 0, F.when(n_hyp == 0, F.lit(1.0))
                           .otherwise(1 - F.col("H") * F.col("H") / (n_ref * n_hyp))).alias("corpus_wil"),
                    F.col("H").alias("hits"), F.col("S").alias("subs"),
                    F.col("D").alias("dels"), F.col("I").alias("ins"))


def corpus_ter(df: DataFrame, keys: list[str], edits: str = "ter_edits", ref_len: str = "ter_ref_len") -> DataFrame:
    """A5: 100 * sum(edits) / sum(reference words); no reference words -> 0 or 100."""
    g = df.groupBy(*keys).agg(F.sum(edits).alias("E"), F.sum(ref_len).alias("R"))
    ter = F.when(F.col("R") > 0, 100.0 * F.col("E") / F.col("R")) \
           .when(F.col("E") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return g.select(*keys, ter.alias("corpus_ter"))


def corpus_mean(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Mean of segment scores; failed (NULL) segments are skipped."""
    return df.groupBy(*keys).agg(F.avg(col).alias(out))


def first_metadata(df: DataFrame, keys: list[str], order: str, meta: list[str]) -> DataFrame:
    """The metadata of each group's first row by ``order``."""
    s = F.min_by(F.struct(*meta), F.col(order))
    return df.groupBy(*keys).agg(s.alias("__m")).select(*keys, *[F.col(f"__m.{m}").alias(m) for m in meta])


def run_counts(df: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Row count per key and, optionally, how many carry a flag."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if flag:
        aggs.append(F.count_if(F.col(flag)).alias(f"n_{flag}"))
    return df.groupBy(*keys).agg(*aggs)


# --- W: windows -------------------------------------------------------------

def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last result wins per key (max_by, so no sort of whole groups)."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("__r"))
              .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]))


def batch_no(df: DataFrame, keys: list[str], pos: str, n: int, out: str = "batch_no") -> DataFrame:
    """Consecutive batches of ``n`` rows per key by position.

    With a dense position per key the batch number is plain arithmetic, so no
    window (and no shuffle) is needed; ``dense_pos`` makes any order dense.
    """
    return df.withColumn(out, F.floor(F.col(pos) / n).cast("bigint"))


def dense_pos(df: DataFrame, keys: list[str], order: str, out: str = "pos") -> DataFrame:
    """Dense 0-based position per key (row_number over the key's order)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))


# --- O, U: sort, limit, sets ------------------------------------------------------

def sort_inputs(df: DataFrame, col: str = "path") -> DataFrame:
    """O1."""
    return df.orderBy(col)


def head_n(df: DataFrame, pos: str, n) -> DataFrame:
    """O2: first ``n`` items of each list (``n`` may be a column, e.g. the other list's length)."""
    return df.filter(F.col(pos) < (n if isinstance(n, Column) else F.lit(n)))


def compile_results(*parts: DataFrame) -> DataFrame:
    """Union by name, missing columns NULL, known columns first."""
    return order_columns(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def union_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2."""
    return a.unionByName(b)


# --- S10, S11: incremental work ------------------------------------------------

def skip_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet done (left anti join on the work key)."""
    return todo.join(done.select(*keys), keys, "left_anti")


def require_inputs(todo: DataFrame, inputs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(work whose input exists, work whose input is missing -> reject rows)."""
    have = inputs.select(*keys)
    return (todo.join(have, keys, "left_semi"),
            todo.join(have, keys, "left_anti").withColumn("reject_reason", F.lit("missing_input")))
