"""The operators over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import unnest
from . import bpe, cascade, decontam, langid, license, linetemplates, revisit, simhash, spelling, surrogate, toxicity, turntrie, urlfilter
from .common import read, remainder, written
from .oracles import ORACLE_SQL  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    encoded = bpe.encode(docs, bpe.compile_file(TOKENIZER), decoded="decoded")
    return encoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents", "doc_id", "text"), words=3, bits=2, seed=42)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.indexes(read(spark, sf_dir, "benchmark", "item_id", "text"))
    return decontam.matches(read(spark, sf_dir, "documents", "doc_id", "text"), found)


def capture_records(pages: DataFrame) -> DataFrame:
    """Archive records derived from ``pages``: for each page a full response and three
    revisits, with times and validators made from the page's id and content."""
    i, body = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(body.cast("binary")), F.lit('"'))
    modified = F.concat(F.lit("day "), (i % 97).cast("string"))
    ts = F.lit(1_700_000_000) + (i * 7919) % 1_000_003
    size = F.length(body.cast("binary")).cast("string")

    def record(n: int, at, kind: str, status: int, *headers):
        present = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in headers)), lambda h: h["value"].isNotNull())
        return F.struct(
            (4 * i + n).alias("record_id"), F.col("url").alias("url"), at.alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"),
            F.map_from_entries(present).alias("headers"),
        )

    records = F.array(
        record(0, ts, "response", 200, ("Content-Type", F.lit("text/html")), ("Content-Length", size), ("Cache-Control", F.lit("max-age=60")),
               ("ETag", F.when(i % 5 != 4, tag)), ("Last-Modified", F.when(i % 7 != 6, modified))),
        record(1, ts + 100 + i % 50, "revisit", 304, ("ETag", F.when(i % 3 == 0, F.concat(F.lit("W/"), tag)).when(i % 3 == 1, tag).otherwise('"other"')),
               ("Cache-Control", F.lit("max-age=120")), ("Content-Length", F.lit("0")), ("Connection", F.lit("close, X-Hop")), ("X-Hop", F.lit("1")), ("X-Cache", F.lit("hit"))),
        record(2, ts - 10, "revisit", 304, ("Date", F.lit("earlier"))),
        record(3, ts + 500, "revisit", 304, ("Last-Modified", F.when(i % 4 != 0, modified).otherwise("day 1000")), ("Expires", F.lit("0"))),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")


def op5_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(capture_records(read(spark, sf_dir, "pages", "page_id", "url", "html")))
    return found.select("record_id", "url_key", "outcome", "response_id", revisit.header_lines(F.col("merged")).alias("headers"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model, extra={"held_out": held_out})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.predict(docs, model, extra={"held_out": held_out})


# The key of the surrogates; a user passes a secret one.
SURROGATE_KEY = b"corposcope example key"


def op8_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.pseudonymise(read(spark, sf_dir, "documents", "doc_id", "text"), SURROGATE_KEY)


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetemplates.drop_recurring(read(spark, sf_dir, "documents", "doc_id", "text"), counts=True)


CASCADE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op10_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    judged = cascade.judge(docs, measures=CASCADE_COUNTS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *CASCADE_COUNTS, failed.alias("base_failed"), "kept")


# Letters of a run, and the letters that are lower-cased.
RUN, UPPER, LOWER = r"[a-z\u00C0-\u00FF]{7,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelled_words(docs: DataFrame) -> DataFrame:
    """(word): the letter runs of whole texts, some of them with a code point left out.

    Shorter runs than 7 cannot give a word of 7 code points, so they are not taken out.
    A null key counts as '' in the hash.
    """
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    runs = unnest(docs, found, "run", "doc_id")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % 31 == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= 7)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelled_words(read(spark, sf_dir, "documents", "doc_id", "text"))
    return spelling.variants(spelling.vocabulary(words, least=2), ratio=10)


def op12_turntrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(turntrie.sequences(read(spark, sf_dir, "conversations")), "turns")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return turntrie.trie(turntrie.rebuilt(own, shared, F.col("conv_id") - F.col("conv_id") % 100, most=5))


URL_RULES = urlfilter.Filter(
    [
        urlfilter.Rule("allow", "org", "/"),
        urlfilter.Rule("block", "example.org", "/es/"),
        urlfilter.Rule("block", "example.org", "/en/1"),
        urlfilter.Rule("allow", "com", "/fr/"),
        urlfilter.Rule("block", "com", "/de/"),
    ]
)


def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_license": op3_license,
    "op4_decontamination": op4_decontamination,
    "op5_revisit": op5_revisit,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_surrogate": op8_surrogate,
    "op9_line_templates": op9_line_templates,
    "op10_cascade": op10_cascade,
    "op11_spelling": op11_spelling,
    "op12_turntrie": op12_turntrie,
    "op13_urlfilter": op13_urlfilter,
}

