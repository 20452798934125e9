"""The queries op1 to op13 and ``pipeline`` with production parameters, and their SQL.

Each reads its whole tables through its operator, whose docstring tells what null, empty,
repeated and very long rows come to; an empty table gives no rows, columns beside those
that are named are not read, and a row without doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import ann, collocation, importance, language_id, language_model, line_dedup, packing, quality, quality_classifier, sentencepiece_codec, simhash, toxicity, url_filter
from siftline.llm.common import crc_mod, table, tokenizer_path


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated multi-line chunks."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PATTERN_RULES = [
    ("advert", r"/(?:ad|ads|adserver|banner|banners)/"),
    ("affiliate", r"[?&]ref=[a-z0-9]{1,3}(?:&|#|$)"),
    ("deep-page", r"[?&]page=[0-9]{3,}(?:&|#|$)"),
    ("session", r"[?&](?:sid|phpsessid|jsessionid)=[^&#]+"),
    ("redirect", r"[?&](?:url|redirect|goto)=https?(?::|%3a)"),
    ("gambling", r"[./_-](?:casino|poker|slots|betting)[./_-]"),
    ("login", r"/(?:login|signin|logout)(?:[./?#]|$)"),
    ("calendar", r"/calendar/[0-9]{4}/[0-9]{2}/"),
    ("print", r"[?&]print=1(?:&|#|$)"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    rules = [url_filter.host_rule(*x) for x in HOST_RULES] + [url_filter.pattern_rule("block", *x) for x in PATTERN_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def _op5_sql() -> str:
    parts = sorted(((verdict, *rule.partition("/")[::2], rule) for verdict, rule in HOST_RULES), key=lambda x: -len(x[3]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{r}'" for _, h, p, r in parts) + " end"
    said = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p, _ in parts) + " end"
    pattern = "case " + " ".join(f"when regexp_matches(url, '(?i){p}') then '{n}'" for n, p in PATTERN_RULES) + " end"
    return f"""
with u as (select page_id, coalesce(url, '') as url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, url, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, url, lower(raw) as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from s),
r as (select *, {rule} as rule, {said} as said, {pattern} as pat from p)
select page_id, host, path, rule, coalesce(said, case when pat is null then 'allow' else 'block' end) as verdict, case when rule is null then pat end as pattern from r
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learnable(docs))
    return language_id.identify(docs, model).select("doc_id", _fold(4, 2), "lang_pred", "score", "strange")


def _fold(m: int, held: int):
    """held_out: the row's crc32(doc_id as text) mod m is ``held``."""
    return F.coalesce(crc_mod("doc_id", m) == held, F.lit(False)).alias("held_out")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", _fold(5, 0), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document."""
    return language_model.score(table(spark, sf_dir, "documents"), held_mod=(7, 2))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group of near duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), most=3)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.learnable(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model).select("doc_id", _fold(5, 0), "score", "predicted")


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of two to four words."""
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight against the benchmark texts, and the ranks of those drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_ann": op3_ann,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_language_model": op9_language_model,
    "op10_simhash": op10_simhash,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_collocation": op12_collocation,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.oracle(),
    "op5_url_filter": _op5_sql(),
}
