"""Plain definitions that the operators are held against."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rule_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def fingerprint(text, size=4):
    words = WORDS.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, near):
    """Smallest reachable id by brute force over all pairs."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[a] > root[b] and near(a, b):
                    root[a], changed = root[b], True
    return root


def personal(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c not in " -"]
        total = sum(sum(divmod(v * (1 + k % 2), 10)) for k, v in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def quality_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n, k = max(len(words), 1), max(len(lines), 1)
    chars = max(sum(map(len, words)), 1)
    per_word = lambda kind: len(re.findall(kind, text)) / n
    return (
        float(np.log1p(len(words))), chars / n, len(set(words)) / n, per_word(r"[#*$%&|<>]"), per_word("[A-Z]"), per_word("[!?]"), per_word("[0-9]"),
        per_word("[.]"), per_word("[,;]"), sum(len(c.encode()) - 1 for c in text) / chars, k / n, (len(lines) - len(set(lines))) / k,
        rule_counts(text)[4] / n, float(max((len(w.encode()) for w in words), default=0)),
    )


def boosted(model, row):
    """One row through every tree, node by node."""
    total = model.base
    for feature, cut, value in zip(model.feature, model.cut, model.value):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += value[node]
    return 1 / (1 + np.exp(-total))


TERM = re.compile(r"[^\W_]+")


def disclosing_terms(texts, near, letters, contexts, least):
    """Terms that disclose an entity: 1 + log P(entity | term) / IC(entity) is at least ``least``."""
    meets, around, total, n_words = Counter(), {}, Counter(), 0
    for text in texts:
        text = text or ""
        n_words += len(WORDS.findall(text))
        total.update(TERM.findall(text.lower()))
        spans = personal(text)
        free = lambda m: all(m.end() <= a or b <= m.start() for _, a, b in spans)
        for kind, a, b in spans:
            name = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[^0-9]", "", text[a:b])
            beside = [m[0].lower() for m in TERM.finditer(text, 0, a) if free(m)][-near:] + [m[0].lower() for m in TERM.finditer(text, b) if free(m)][:near]
            for w in beside:
                if len(w) >= letters:
                    meets[w, kind, name] += 1
                    around.setdefault((w, kind, name), set()).add(" ".join(beside))
    of_entity = Counter()
    for (_, kind, name), n in meets.items():
        of_entity[kind, name] += n
    out = set()
    for (w, *entity), n in meets.items():
        if len(around[w, *entity]) >= contexts:
            e = of_entity[tuple(entity)]
            information = np.log(max(n_words, e + 1) / e)
            if 1 + np.log(n / max(total[w] + 1, n)) / information >= least:
                out.add(w)
    return out


def term_spans(text, terms):
    text = text or ""
    base = personal(text)
    return [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(text) if m[0].lower() in terms and all(m.end() <= a or b <= m.start() for _, a, b in base)]


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc_fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def contained(docs, items, size=5, least=0.8):
    """(doc, item, found) with at least ``least`` of the item's distinct shingles in the document."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for j, item in items:
        w = words(item)
        k = min(size, len(w))
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i, text in docs:
            v = words(text)
            have = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if k else set()
            if want and len(want & have) >= least * len(want) - 1e-9:
                out.add((i, j, len(want & have)))
    return out


def license_places(text):
    words = RUNS.findall((text or "").translate(ASCII_LOWER))
    out = {}
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if at:
            out[label] = at
    return len(words), out


def best_fit_total(lengths, capacity=2048):
    return int(np.ceil(sum(lengths) / capacity))
