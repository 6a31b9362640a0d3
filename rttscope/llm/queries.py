"""The registered queries: each applies its operator to a whole table, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rttscope.llm import anomaly, chat, checks, contamination, filter_audit, licenses, mixing, packing, pii, quality_trees, repair, simhash, toxicity, url_rules

#: Host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_contamination(spark, sf_dir):
    return contamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark, sf_dir):
    return quality_trees.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_rules(spark, sf_dir):
    return anomaly.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(*anomaly.RATIOS)


def op7_chat(spark, sf_dir):
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.read_back(chat.formatted(chat.reply_chain(rows)))
    both = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(both, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark, sf_dir):
    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mixing(spark, sf_dir):
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_repair(spark, sf_dir):
    return repair.summary(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_contamination, op2_quality, op3_urls, op4_packing, op5_licenses, op6_rules, op7_chat, op8_toxicity, op9_simhash, op10_pii, op11_filter_audit, op12_mixing, op13_repair)}

_UPPER, _LOWER = url_rules.UPPER, url_rules.LOWER
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_URLS = f"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(rhost, rpath, verdict) as (values {_RULES}),
best as (
  select host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
  from (select distinct host, path from parts) p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by host, path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (host, path)
"""

_ESCAPED = "replace(replace(replace(coalesce({0}, ''), '\\', '\\e'), '<', '\\l'), '[', '\\b')"
_CHAT = f"""
with msgs as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}'),
joined as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum({len(chat.TURN) + len(chat.END) + 1} + length(replace({_ESCAPED.format('role')}, chr(10), '\\n')) + length({_ESCAPED.format('text')})) as formatted_chars
  from msgs group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars from joined
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOTICES = ", ".join(f"({k}, '{label}', {len(notice.split())}, list_distinct(string_split('{notice}', ' ')))" for k, (label, notice) in enumerate(licenses.TEMPLATES))
_STARTS = " || ".join(
    "[i for i in range(1, len(w) + 1) if " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + "]" for p, _ in licenses.PHRASES)
_BASE = ", ".join(
    "case when len([i for i in range(1, len(w) + 1) if " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f"]) > 0 then '{label}' end" for p, label in licenses.PHRASES)
_LICENSES = f"""
with low as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
words as (select doc_id, r, regexp_extract_all(t, '{_WORD}') as w from low),
base as (
  select doc_id, r, len(w) as n_words, {_STARTS} as starts, [x for x in [{_BASE}] if x is not null] as labels from words),
lines as (
  select r, words, lens, unnest(range(1, len(lens) + 1)) as i from (
    select r, w as words, list_filter([len(regexp_extract_all(l, '{_WORD}')) for l in string_split(t, chr(10))], lambda n: n > 0) as lens from low join words using (r))),
notices(k, label, n, m) as (values {_NOTICES}),
sets as (
  select r, i, list_distinct(words[coalesce(list_sum(lens[1:i - 1]), 0)::bigint + 1 : list_sum(lens[1:i])::bigint + (select max(n) from notices) - 1]) as b from lines),
met as (
  select r, i, label, list_intersect(m, b) as shared, len(list_intersect(m, b)) / len(m) as part from sets join notices on len(b) >= {licenses.CONTAINMENT} * len(m) - 1e-9
  where len(list_intersect(m, b)) >= {licenses.CONTAINMENT} * len(m) - 1e-9),
apart as (select * from met x where not exists (from met y where y.r = x.r and y.i = x.i and y.part > x.part and list_has_all(y.shared, x.shared))),
method as (select r, list(distinct label) as labels, max(part) as part from apart group by r)
select doc_id, n_words, len(starts) as n_base, list_min(starts) - 1 as first_word, list_max(starts) - 1 as last_word,
  array_to_string(list_sort(list_distinct(base.labels)), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base.labels || coalesce(method.labels, []))), ',') as labels,
  case when len(starts) > 0 then 1.0 else coalesce(part, 0.0) end::double as score
from base left join method using (r)
"""

ORACLE = {"op3_urls": _URLS, "op5_licenses": _LICENSES, "op7_chat": _CHAT, **checks.ORACLE}
