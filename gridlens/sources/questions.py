"""Question ingestion: schema-on-read, rejects with reasons, deduplication and prior-use exclusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions import text as X
from gridlens.functions.choices import gold_parser, parse_choices
from gridlens.operators.distributed import first_per_key, global_row_number, materialize

# Raw field names in order of preference, and the numeric base of the gold fields.
STEM_FIELDS = ("question_clean", "question", "question_text", "stem", "prompt", "query")
CHOICE_FIELDS = ("options", "choices", "answer_options", "answer_choices", "mcq_options")
GOLD_FIELDS = {"answer_idx": 0, "answer_index": 0, "correct_option": None, "correct_answer": None, "answer": 1,
               "label": 1, "gold": 1, "correct": 1}
ID_FIELDS = ("id", "sample_id", "question_id", "qid", "uid", "index")
MEDIA_FIELDS = ("image", "images", "image_path", "image_paths", "figure", "figures", "table", "tables", "audio", "video")
# Fixed value: wording that points to a picture or table.
MEDIA_STEM = (
    r"(?i)\b(?:shown|depicted|illustrated|pictured)\s+(?:above|below|here)|"
    r"\b(?:the|this|following)\s+(?:image|figure|radiograph|x[- ]?ray|ct|mri|"
    r"ultrasound|photograph|ecg|ekg|tracing|graph|chart|table|diagram)|"
    r"\bin\s+(?:the|this)\s+(?:image|figure|table|radiograph|scan|tracing)\b"
)
TEST_SPLITS = ("test", "internal test", "internaltest")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, *, strict: bool = True) -> DataFrame:
    """JSON lines under a declared schema; strict reading fails on the first malformed line."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(paths)


def read_jsonl_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not JSON objects, with their file."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    broken = parsed.isNull() | ~F.trim("value").startswith("{")
    return lines.select(F.input_file_name().alias("file"), "value").filter(broken)


def read_raw_questions(spark: SparkSession, path: str) -> DataFrame:
    """Every raw line as a variant, with its zero-based row number over the files in the order of their names.

    Within a split, rows come in file order; splits are ordered by file and by where they start in it.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    numbered = global_row_number(lines.filter(F.trim("value") != ""), ["file", "block", "place"], "row")
    return numbered.select(F.parse_json("value").alias("raw"), (F.col("row") - 1).alias("row_index"))


def _field(name: str) -> Column:
    return F.try_variant_get("raw", f"$.{name}", "string")


def _first_text(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(X.collapse(_field(n)), F.lit("")) for n in names])


def wanted_split(split: Column, partition: Column, subset: Column) -> Column:
    """Rows of the test split; rows that name no split stay."""
    named = F.trim(F.regexp_replace(F.lower(F.coalesce(split, partition, subset)), r"[^\p{L}\p{N}]+", " "))
    return named.isNull() | named.isin(list(TEST_SPLITS))


# The words that open a block of choices inside a question, and a choice's label there.
BLOCK = r"(?is)^(.*)\s+Answer\s+Choices\s*:\s*(.*)$"
BLOCK_LABEL = r"(?i)\(([A-Z])\)\s*"
#: Keeps normalised texts apart that are normalised together.
_BETWEEN = "betweentexts"


def _all_normalized(texts: Column) -> Column:
    """Normalised elements of an array of texts, by one pass over all of them."""
    joined = X.normalized(F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), f" {_BETWEEN} "))
    return F.transform(F.split(joined, _BETWEEN), lambda t: F.trim(t))


def strip_choice_block(stem: Column, choices: Column) -> Column:
    """Struct (stem, removed): the stem without a last block that repeats exactly the structured choices.

    A block with other labels, another order or other texts stays, as does one with nothing before it.
    """
    head, block = F.rtrim(F.regexp_extract(stem, BLOCK, 1)), F.trim(F.regexp_extract(stem, BLOCK, 2))
    labels = F.transform(F.regexp_extract_all(block, F.lit(BLOCK_LABEL), F.lit(1)), lambda x: F.upper(x))
    texts = F.split(block, BLOCK_LABEL)
    texts = F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))
    same = (labels == F.transform(choices, lambda c: c["label"])) & (
        _all_normalized(texts) == _all_normalized(F.transform(choices, lambda c: c["text"])))
    removed = F.coalesce((head != "") & (F.size(labels) > 0) & same, F.lit(False))
    return F.struct(F.when(removed, head).otherwise(stem).alias("stem"), removed.alias("removed"))


def _settled(frame: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once here, however many expressions behind name them.

    The optimiser copies a column into every expression that uses it; it does not look through a generator.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return frame.select(*[c for c in frame.columns if c not in columns], made).select("*", "_settled.*").drop("_settled")


def normalize_questions(raw: DataFrame, dataset: Column, source_split: Column, embedded: Column | None = None) -> DataFrame:
    """Normalised questions with a ``reject_reason`` column; nothing is dropped.

    Several choice or gold fields must agree, a disagreement is a reject and not a guess.  A block at the end of a stem that
    mirrors the choices is cut off; where ``embedded`` holds, a source is known to have one, and a row without it is rejected.
    """
    expected = F.lit(False) if embedded is None else F.coalesce(embedded, F.lit(False))
    parsed = raw.select(
        "row_index", expected.alias("_expected"), dataset.alias("dataset"), source_split.alias("source_split"), _first_text(STEM_FIELDS).alias("stem"),
        _first_text(ID_FIELDS).alias("_id"),
        F.array(*[F.coalesce(_field(m), F.lit("")) for m in MEDIA_FIELDS]).alias("_media"),
        *[_field(f).alias(f"_g_{f}") for f in GOLD_FIELDS],
        *[parse_choices(_field(f)).alias(f"_c{i}") for i, f in enumerate(CHOICE_FIELDS)])
    candidates = F.array_compact(F.array(*[F.col(f"_c{i}.choices") for i in range(len(CHOICE_FIELDS))]))
    broken = F.coalesce(*[F.col(f"_c{i}.reason") for i in range(len(CHOICE_FIELDS))])
    chosen = _settled(parsed, _found=F.array_distinct(candidates), _broken=broken).withColumn("choices", F.get("_found", F.lit(0)))
    chosen = _settled(chosen, _cut=strip_choice_block(F.col("stem"), F.col("choices"))).withColumn("stem", F.col("_cut.stem"))
    read = chosen.select("*", *[gold_parser(base)(F.col(f"_g_{f}"), F.col("choices")).alias(f"_r_{f}")
                                for f, base in GOLD_FIELDS.items()])
    every = F.array_distinct(F.flatten(F.array(*[F.col(f"_r_{f}.labels") for f in GOLD_FIELDS])))
    sources = F.array_compact(F.array(*[F.when(F.size(F.col(f"_r_{f}.labels")) > 0, F.lit(f)) for f in GOLD_FIELDS]))
    malformed = F.array_compact(F.array(*[F.when(F.col(f"_r_{f}.malformed"), F.lit(f)) for f in GOLD_FIELDS]))
    joined = _settled(read, _gold=every, _sources=sources, _malformed=malformed)
    gold = F.when(F.size("_gold") == 1, F.col("_gold")[0])
    reason = (
        F.when(F.col("stem").isNull(), "missing stem")
        .when(F.exists("_media", lambda m: ~m.isin("", "[]", "{}", "null")) | F.col("stem").rlike(MEDIA_STEM), "media dependent")
        .when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(F.size("_found") == 0, "missing choices")
        .when(F.size("_found") > 1, "conflicting choice fields")
        .when(F.size("choices") < 2, "fewer than two choices")
        .when(F.col("_expected") & ~F.col("_cut.removed"), "no block that mirrors the choices")
        .when(F.size("_gold") == 0, "missing or unreadable gold")
        .when(F.size("_gold") > 1, "conflicting gold fields")
    )
    identifier = F.concat(F.col("dataset"), F.lit(":"), F.coalesce(
        F.col("_id"), F.concat(F.lit("row-"), F.col("row_index").cast("string"))))
    return joined.select(
        "row_index", identifier.alias("id"), "dataset", "source_split", "stem", "choices", gold.alias("gold"),
        F.get(F.filter("choices", lambda c: c["label"] == gold), F.lit(0))["text"].alias("gold_text"),
        F.array_join("_sources", "+").alias("gold_source"),
        F.to_json(F.struct((F.size("_malformed") > 0).alias("malformed"), F.col("_malformed").alias("fields"))).alias("gold_raw"),
        reason.alias("reject_reason"))


def accept(questions: DataFrame) -> DataFrame:
    """Accepted questions, the first of every id; they are stored, so that nothing is read twice from its raw form."""
    kept = materialize(questions.filter("reject_reason is null").drop("reject_reason"))
    return first_per_key(kept, ["id"], "row_index")


def rejection_histogram(questions: DataFrame) -> DataFrame:
    return questions.filter("reject_reason is not null").groupBy("dataset", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def with_stem_key(questions: DataFrame, stem: str = "stem") -> DataFrame:
    """Digest of the normalised stem; comparisons shuffle it instead of the text."""
    return questions.withColumn("stem_key", F.sha2(X.normalized(F.col(stem)), 256))


def unique_stems(questions: DataFrame, row_id: str = "row_index") -> DataFrame:
    return first_per_key(questions, ["stem_key"], row_id)


def exclude_used(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Questions whose id and stem are both unused; two anti-joins, since an OR would not be an equi-join."""
    by_id = questions.join(ledger.select("id"), "id", "left_anti")
    return by_id.join(ledger.select("stem_key"), "stem_key", "left_anti")


def ledger_additions(entries: DataFrame) -> DataFrame:
    """Ids and stems that each ledger is the first to contribute; ``entries`` has ledger_index, id and stem_key."""
    ids = entries.groupBy("id").agg(F.min("ledger_index").alias("ledger_index")).groupBy("ledger_index").agg(
        F.count(F.lit(1)).alias("new_ids"))
    stems = entries.groupBy("stem_key").agg(F.min("ledger_index").alias("ledger_index")).groupBy("ledger_index").agg(
        F.count(F.lit(1)).alias("new_stems"))
    return ids.join(stems, "ledger_index", "full").select(
        "ledger_index", F.coalesce("new_ids", F.lit(0)).alias("new_ids"), F.coalesce("new_stems", F.lit(0)).alias("new_stems"))


def across_datasets(questions: DataFrame, priority: Column, row_id: str) -> DataFrame:
    """Every stem stays with the dataset of highest priority, so one pass replaces a join per dataset."""
    keyed = questions.withColumn("_rank", priority)
    winners = keyed.groupBy("stem_key").agg(F.min("_rank").alias("_rank"))
    return keyed.join(winners, ["stem_key", "_rank"], "left_semi").drop("_rank")


def read_document_frequencies(spark: SparkSession, path: str, terms: DataFrame) -> tuple[int, DataFrame]:
    """Corpus size and document frequencies of the wanted terms from a (compressed) table of yearly counts.

    The total row has a blank or total-like word; of several rows for one word the last counts.
    """
    table = spark.read.option("header", True).csv(path)
    years = [c for c in table.columns if c != table.columns[0]]
    if table.columns[0] != "word" or len(years) < 9:
        raise ValueError("a frequency table needs a word column and at least nine yearly columns")
    counted = table.select(
        "word", sum((F.coalesce(F.col(f"`{y}`").cast("bigint"), F.lit(0)) for y in years), F.lit(0)).alias("df"),
        F.monotonically_increasing_id().alias("_row"))
    is_total = F.col("word").isNull() | F.lower("word").isin("total", "totals", "__total__", "all")
    total = counted.filter(is_total).agg(F.max_by("df", "_row")).first()[0]
    if total is None:
        raise ValueError("the frequency table has no total row")
    wanted = counted.filter(~is_total).join(terms.select(F.col("term").alias("word")), "word", "left_semi")
    latest = first_per_key(wanted, ["word"], "_row", last=True).select(F.col("word").alias("term"), "df")
    return total, terms.select("term").join(latest, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
