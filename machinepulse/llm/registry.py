"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from machinepulse.llm import (
    bpe,
    compression_bands,
    content_sort,
    decontaminate,
    html_density,
    language,
    lexical_search,
    ngram_join,
    period_runs,
    secrets,
    statements,
    toxicity,
    url_filter,
    warc,
)
from machinepulse.llm.common import bucket, read

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_density.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(read(spark, sf_dir, "documents"), keep="largest")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train=toxicity.training_rows())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, train=language.training_rows())
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select(
        "doc_id",
        F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("language.lang_pred"),
        F.col("language.score"),
        F.col("language.ambiguous"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(TOKENIZER)
    return digests(bpe.decode(bpe.encode(docs, path), path))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(read(spark, sf_dir, "pages"))
    page = lambda name: F.expr(f"try_cast(split({name}, ':')[2] AS bigint)")
    return warc.read_archives(spark, manifest).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


# The rules the query is asked for.
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind))
    return docs.select(
        "doc_id",
        *(count(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", _repeated().alias("text"))
    found = period_runs.find(docs).select("doc_id", "periodic.*")
    longest = F.get(
        F.array_sort(
            F.transform(
                "runs",
                lambda r: F.struct(
                    (-r["length"]).alias("order"), r["start"].alias("start"),
                    r["period"].alias("period"), r["length"].alias("length"),
                ),
            )
        ),
        F.lit(0),
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(longest[field].alias(field) for field in ("start", "length", "period")),
        F.floor(F.try_divide(1000 * longest["length"], longest["period"])).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _repeated() -> Column:
    """The text, of which a tenth by hash repeats a stretch of words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when(
        (h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    ).otherwise(F.col("text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fields = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept ratio verdict"
    )
    return compression_bands.judge(docs).select(
        "doc_id", *(F.col(f"quality.{field}") for field in fields.split())
    )


def digests(docs: DataFrame) -> DataFrame:
    """What op8 returns, from documents with ids and decoded."""
    return docs.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    found = {
        name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()
    }
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return statements.all_statements()
