"""Personal data: fixed patterns, and terms that give the found entities away.

Emails, IP addresses, card and phone numbers are found by pattern.  Each distinct value is a
protected entity ``e``.  Terms within ``NEAR`` words of an entity are counted with it, and all terms so met
are counted over the whole corpus.  With P(e|t) the share of a term's places that lie near ``e`` and
IC(e) = -log P(e) the information that the entity carries, a term discloses

    PMI(t, e) / IC(e) = 1 + log P(e|t) / IC(e)

of it.  Terms above ``GENERALISE`` are replaced by their kind, terms above ``REMOVE`` are removed, wherever
they occur.  A term must be seen with the entity in ``LEAST_CONTEXTS`` different surroundings, so copies of
one text prove nothing.

Defined results: a null text counts as empty and has no spans; repeated rows get the same spans and count
as often as they occur; null ids are kept; an empty table gives an empty result.  Only the id and
text columns are read by ``find``; ``sanitise`` keeps all columns.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope.llm.contamination import bit_filter
from rttscope.llm.text import free_names, map_texts
from rttscope.session import materialise

KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does; the look-behind spares the tries inside it
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]+")
NEAR = 8
LEAST_LETTERS = 3
LEAST_CONTEXTS = 2
GENERALISE = 0.85
REMOVE = 0.95


def emails(text: str):
    """Spans of the email pattern, leftmost and non-overlapping, by a scan over ``@`` signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def is_term(word: str) -> bool:
    return len(word) >= LEAST_LETTERS


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(term, entity, surroundings) for the terms near each span; other entities are no terms."""
    out = []
    covered = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        value = text[a:b].lower() if kind == "email" else "".join(DIGITS.findall(text[a:b])) if kind != "ip" else text[a:b]
        # NEAR words are looked for in a stretch of text that usually holds them, which grows until it does
        words, reach = [], 40 * NEAR
        while True:
            low, high = max(0, a - reach), min(len(text), b + reach)
            before = [m for m in TERM.finditer(text, low, a) if m.start() > low or low == 0]
            after = [m for m in TERM.finditer(text, b, high) if m.end() < high or high == len(text)]
            if (len(before) >= 4 * NEAR or low == 0) and (len(after) >= 4 * NEAR or high == len(text)):
                break
            reach *= 4
        free = lambda m: not any(x < m.end() and m.start() < y for x, y in covered)
        words = [m[0].lower() for m in [x for x in before if free(x)][-NEAR:] + [x for x in after if free(x)][:NEAR]]
        around = digest(" ".join(words))
        entity = digest(f"{kind}:{value}")
        out += [(digest(w), entity, around) for w in words if is_term(w)]
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a hash of the text beside it (ids may repeat or be null), and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def base_table(rows: DataFrame) -> DataFrame:
    """Every row's pattern spans, its words, and the contexts of its entities."""
    kind = rows.schema["id"].dataType.simpleString()

    def of(ids, hashes, texts):
        out = []
        for i, h, text in zip(ids, hashes, texts, strict=True):
            spans = base_spans(text)
            near = contexts(text, spans) if spans else []
            out.append((i, h, len(text.encode("utf-8", "surrogatepass").split()), [{"kind": k, "start": a, "end": b} for k, a, b in spans],
                        [{"term": t, "entity": e, "around": c} for t, e, c in near]))
        return out

    return map_texts(rows, ["id", "h", "text"], f"id {kind}, h long, n_words long, spans array<struct<kind:string,start:int,end:int>>, near array<struct<term:long,entity:long,around:long>>", of)


class Seen(dict):
    """A word's digest if it passes the filter, else 0; emptied when large."""

    def __init__(self, bitmap: np.ndarray):
        self.bits = bitmap.tobytes()

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        d = digest(word)
        place = d % (8 * len(self.bits))
        self[word] = found = d if self.bits[place >> 3] >> (place & 7) & 1 and is_term(word) else 0
        return found


def places_of(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(term, n): how often each term that passes the filter occurs, summed per task first."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def run(batches):
        import pyarrow as pa

        seen, counts = Seen(shared.value), Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(start, 64).to_pylist():
                    counts.update(map(seen.__getitem__, TERM.findall(text.lower())))
            counts.pop(0, None)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()

    return rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def term_places(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(id, h, term, start, end) of every occurrence that passes the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size
    kind = rows.schema["id"].dataType.simpleString()
    memo: list[Seen] = []

    def of(ids, hashes, texts):
        if not memo:
            memo.append(Seen(shared.value))
        seen, out = memo[0], []
        for i, h, text in zip(ids, hashes, texts, strict=True):
            words = list(map(seen.__getitem__, TERM.findall(text.lower())))
            if any(words):
                # lower-casing may change a text's length, so places are taken from the text itself
                out += [(i, h, d, *m.span()) for m in TERM.finditer(text) if (d := seen[m[0].lower()])]
        return out

    return map_texts(rows, ["id", "h", "text"], f"id {kind}, h long, term long, start int, end int", of, 64)


def disclosure(base: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, disclosed): the most that a term discloses of any entity, where it exceeds ``GENERALISE``."""
    near = base.select(F.explode("near").alias("x")).select("x.*")
    once = near.groupBy("term", "entity", "around").agg(F.count("*").alias("n"))
    pairs = once.groupBy("term", "entity").agg(F.sum("n").alias("n_both"), F.count("*").alias("around")).where(F.col("around") >= LEAST_CONTEXTS)
    pairs = materialise(pairs, "term-entities")
    entities = once.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    n = base.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    totals = places_of(rows, bit_filter(pairs.select(F.col("term").alias("hash"))))
    ic = F.log(F.greatest(F.lit(float(n)), F.col("n_entity") + 1.0) / F.col("n_entity"))
    share = F.col("n_both") / F.greatest(F.col("n") + 1, F.col("n_both"))
    scored = pairs.join(totals, "term").join(entities, "entity").select("term", (1 + F.log(share) / ic).alias("disclosed"))
    return materialise(scored.groupBy("term").agg(F.max("disclosed").alias("disclosed")).where(F.col("disclosed") >= GENERALISE), "disclosing-terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans): for every row, (kind, start, end, disclosed) by kind, then start; terms come last."""
    rows = keyed(docs, id_col, text_col)
    base = materialise(base_table(rows), "pattern-spans")
    terms = disclosure(base, rows)
    bitmap = bit_filter(terms.select(F.col("term").alias("hash")))
    places = term_places(rows, bitmap).distinct().join(terms, "term")
    found = places.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosed"))).alias("terms"))
    found = materialise(found, "term-spans").withColumnsRenamed({"id": "id2", "h": "h2"})
    joined = base.select("id", "h", "spans").join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    # a term inside a pattern span is covered by it
    outside = F.filter(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,disclosed:double>>")),
                       lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    spans = F.concat(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("disclosed"))),
                     F.transform(outside, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["disclosed"].alias("disclosed"))))
    return joined.select("id", "h", spans.alias("spans"))


def rewritten(text: str, spans: list) -> str:
    """The text with each span replaced: patterns and generalised terms by their kind, others by nothing.

    Overlapping pattern spans become one replacement, named by the first.
    """
    out, done = [], 0
    for start, end, word in sorted((s["start"], s["end"], f"[{s['kind'].upper()}]" if s["kind"] != "term" or s["disclosed"] < REMOVE else "") for s in spans):
        if start >= done:
            out += [text[done:start], word]
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of every text replaced; a null text stays null."""
    names = free_names(docs.columns, "pii_id", "pii_h", "pii_spans")
    found = find(docs, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["id", "h"]).select(*(F.col(c).alias(n) for c, n in zip(("id", "h", "spans"), names, strict=True)))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(names[0])) & (h == F.col(names[1])), "left")

    @F.pandas_udf("string")
    def replace(texts, spans):
        import pandas as pd

        return pd.Series([rewritten(t, s) if s is not None and t is not None else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    return joined.withColumn(text_col, replace(F.col(text_col), F.col(names[2]))).drop(*names)


