"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and
phone numbers. The field looks at candidate segments of up to ``MAX_TOKENS``
tokens: numbers in groups, and e-mail addresses written with ``@`` or with
spelled-out marks. Whole-span features (digit count, grouping, separators,
check digit, octets, marks, neighbours) score a segment for its type, and a
dynamic program over token positions chooses boundaries and types jointly;
text outside segments scores zero. It is trained here, by gradient steps on the
conditional likelihood, on a bounded sample of stretches whose labels are the base
patterns, also in other spellings (``SAMPLE`` stretches in hash order, none of more than ``SAMPLE_SEGMENTS`` candidates; the
found field is applied to stretches of any length). Spans that it adds never
replace a base span.

Null texts are empty; very long texts are scanned whole, in time linear in
their length; equal texts get equal spans; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import ast
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import hash_sample, saved

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never starts inside a digit run
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE = 1500
SAMPLE_SEGMENTS = 60
MAX_TOKENS = 16
STEPS = 120
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
#: A chain of digit groups with short separators; and an address with its mark, plain or spelled out.
NUMBERS = re.compile(r"(?:\(\s?)?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
AT = re.compile(r"\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", re.I)
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
AFTER = re.compile(rf"[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
SPELLED = re.compile(r"[\[({]\s?at|\sat\s", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @, so that time is linear."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        m, s = DOMAIN.match(text, at), at
        if m:
            while s > last and text[s - 1] in LOCAL:
                s -= 1
        if m and s < at:
            found.append((s, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return found


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)]
    if any(map(text.__contains__, "0123456789")):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# Whole-span features: every number below is the place of a feature within its type.
N_FEATURES = 48


def number_features(text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    groups = re.findall("[0-9]+", s)
    d = "".join(groups)
    n = len(d)
    f = [0, 1 + min(n, 20)]  # bias, 1..21 number of digits
    f.append(22 + min(len(groups), 7))  # 22..29 groups
    seps = set(re.sub("[0-9]", "", s))
    f.append(30 if not seps else 31 if seps == {"."} else 32 if seps == {" "} else 33 if seps == {"-"} else 34 if "(" in seps else 35)
    shape = tuple(map(len, groups))
    f.append(36 if shape[-3:] == (3, 3, 4) else 37 if shape in ((4, 4, 4, 4), (16,), (4, 6, 5)) else
             38 if len(shape) == 4 and max(shape) <= 3 else 39)
    before, after = text[a - 1:a], text[b:b + 1]
    if before.isalnum() or before in ("_", "=", "#"):
        f.append(40)
    if after.isalnum() or after in ("_", "%"):
        f.append(41)
    return f


def email_features(text: str, a: int, b: int, at: tuple[int, int]) -> list[int]:
    local, domain = text[a:at[0]], text[at[1]:b]
    labels = re.split(DOT, domain, flags=re.I)
    f = [0, 1 + min(len(local) // 4, 5), 7 + min(len(labels), 5)]
    f.append(13 if 2 <= len(labels[-1]) <= 4 and labels[-1].isalpha() else 14)
    if any(c.isdigit() for c in local):
        f.append(15)
    if any(c in "._+-" for c in local):
        f.append(16)
    if SPELLED.search(text[at[0]:at[1]]) and not re.search(r"\bdot\b", domain, re.I):
        f.append(17)
    if text[a - 1:a] in LOCAL and a:
        f.append(18)
    return f


def stretches(text: str) -> list[list[tuple[int, int, int, list[int]]]]:
    """Runs of overlapping candidates: (start, end, type, features), in order of their start."""
    found = []
    if any(map(text.__contains__, "0123456789")):
        for m in NUMBERS.finditer(text):
            if m.end() - m.start() < 7:
                continue
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m[0])]
            for i, (a, _) in enumerate(groups):
                lead = a - 1 if a and text[a - 1] == "(" else a
                n = 0
                for j in range(i, min(len(groups), i + MAX_TOKENS // 2)):
                    n += groups[j][1] - groups[j][0]
                    if n > 19:
                        break
                    e = groups[j][1]
                    parts = [text[x:y] for x, y in groups[i:j + 1]]
                    seps = {text[y:x] for (_, y), (x, _) in zip(groups[i:j], groups[i + 1:j + 1])}
                    if len(parts) == 4 and all(map(octet, parts)) and len(seps) == 1 and "." in next(iter(seps)):
                        found.append((a, e, 1, number_features(text, a, e)))
                    if 13 <= n <= 19 and luhn("".join(parts)):
                        found.append((a, e, 2, number_features(text, a, e)))
                    if 8 <= n <= 15:
                        found.append((lead, e, 3, number_features(text, lead, e)))
    if "@" in text or "at" in text or "AT" in text:
        for m in AT.finditer(text) if "@" in text or re.search(r"[\[({]\s?at|\sdot\s", text, re.I) else ():
            after = AFTER.match(text, m.end())
            if not after or not after[0]:
                continue
            s = m.start()
            while s and text[s - 1] in LOCAL:
                s -= 1
            if s < m.start() and (text[m.start():m.end()].strip() == "@" or re.search(r"\bdot\b", after[0], re.I) or "(" in m[0] or "[" in m[0] or "{" in m[0]):
                found.append((s, after.end(), 0, email_features(text, s, after.end(), m.span())))
    found.sort(key=lambda c: (c[0], c[1], c[2]))
    out, end = [], -1
    for c in found:
        if c[0] >= end:
            out.append([])
        out[-1].append(c)
        end = max(end, c[1])
    return out


def scores(stretch, weights: np.ndarray) -> list[float]:
    return [float(weights[c[2], c[3]].sum()) for c in stretch]


def places(stretch) -> tuple[list[int], dict[int, int]]:
    cuts = sorted({x for c in stretch for x in c[:2]})
    return cuts, {x: i for i, x in enumerate(cuts)}


def best(stretch, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The highest-scoring set of segments that don't overlap (ties: fewer segments)."""
    cuts, at = places(stretch)
    ends: list[list[int]] = [[] for _ in cuts]
    for k, c in enumerate(stretch):
        ends[at[c[1]]].append(k)
    value, back, score = [0.0] * len(cuts), [-1] * len(cuts), scores(stretch, weights)
    for j in range(1, len(cuts)):
        value[j] = value[j - 1]
        for k in ends[j]:
            if (v := value[at[stretch[k][0]]] + score[k]) > value[j] + 1e-9:
                value[j], back[j] = v, k
    out, j = [], len(cuts) - 1
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(stretch[back[j]][:3])
            j = at[stretch[back[j]][0]]
    return out[::-1]


def marginals(stretch, weights: np.ndarray) -> np.ndarray:
    """Probability of each candidate under the field, by forward and backward sums."""
    cuts, at = places(stretch)
    a, b = [at[c[0]] for c in stretch], [at[c[1]] for c in stretch]
    score, n = scores(stretch, weights), len(cuts)
    forward, backward = np.full(n, -np.inf), np.full(n, -np.inf)
    forward[0] = backward[-1] = 0.0
    for j in range(1, n):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[a[k]] + score[k] for k in range(len(a)) if b[k] == j)])
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[b[k]] + score[k] for k in range(len(a)) if a[k] == i)])
    return np.exp([forward[a[k]] + score[k] + backward[b[k]] - forward[-1] for k in range(len(a))])


def gold(stretch, base) -> list[bool]:
    """Candidates that a base span labels; longer spans first where base spans of two kinds overlap."""
    wanted, taken = set(), []
    for kind, s, e in sorted(base, key=lambda x: (x[1] - x[2], x)):
        if all(e <= x or s >= y for x, y in taken):
            taken.append((s, e))
            wanted.add((KINDS.index(kind), s, e))
            if kind == "phone":
                wanted.add((3, s + 1, e))  # segments start behind the plus sign
                wanted.add((3, s + 2, e))
    return [(c[2], c[0], c[1]) in wanted for c in stretch]


def rewritten(text: str, base) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Base spans in other spellings with the text around them: phones without a country code, addresses with words for marks."""
    out = []
    for kind, a, b in base:
        s = text[a:b]
        other = s
        if kind == "phone":
            other = re.sub(r"^\+[0-9]{1,3}[ -]?(?=[(0-9])", "", s)
        elif kind == "email":
            local, domain = s.split("@")
            other = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        if other != s:
            before = re.sub("[0-9@+(]", " ", text[max(0, a - 20):a])
            out.append((before + other + re.sub("[0-9@+(]", " ", text[b:b + 20]), [(kind, len(before), len(before) + len(other))]))
    return out


def train(sample: list[tuple[list, list[bool], int]]) -> np.ndarray:
    """Weights by gradient ascent on the conditional likelihood, with a quadratic penalty."""
    weights, squares = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    weights[:, 0] = -2.0
    if not sample:
        return weights
    for _ in range(STEPS):
        g = -0.02 * weights
        for stretch, labels, times in sample:
            for c, p, y in zip(stretch, marginals(stretch, weights), labels):
                g[c[2], c[3]] += np.sqrt(times) * (y - p)
        squares += g * g
        weights += 0.5 * g / np.sqrt(squares)
    return weights


def sampled(df: DataFrame, text: str = "text", size: int = SAMPLE) -> list[tuple[list, list[bool], int]]:
    """At most ``size`` distinct stretches of all texts, by hash, with labels from the base patterns and their number."""

    @arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            base, rows = base_spans(t or ""), []
            for shown, spans in [(t or "", base), *rewritten(t or "", base)]:
                for s in stretches(shown):
                    if len(s) <= SAMPLE_SEGMENTS:
                        labels, at = gold(s, spans), s[0][0]
                        rows.append(repr(([(a - at, b - at, k, f) for a, b, k, f in s], labels)))
            out.append(rows)
        return pa.array(out, pa.list_(pa.string()))

    rows = saved(df.select(F.explode(found(text)).alias("s")).groupBy("s").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("s")))
    return [(*ast.literal_eval(r.s), r.n) for r in hash_sample(rows, "h", size).collect()]


def method_spans(text: str, base, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans that the field adds: its best segments that overlap no base span."""
    added = [(KINDS[k], a, b) for s in stretches(text) for a, b, k in best(s, weights)]
    return [x for x in added if all(x[2] <= a or x[1] >= b for _, a, b in base)] if base else added


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every text; the counts are of base spans."""
    weights = train(sampled(df, text))

    def spans(batches):
        for batch in batches:
            rows = []
            for t in batch.column("t").to_pylist():
                base = base_spans(t or "")
                added = method_spans(t, base, weights) if t else []
                n = [sum(b[0] == k for b in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *added]), len(added)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[
                "d", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(
        spans, f"d {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    ).withColumnRenamed("d", doc_id)
