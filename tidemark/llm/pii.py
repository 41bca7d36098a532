"""Personal data by weak supervision: regex, gazetteer and context labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import logistic
from .common import cut, in_arrow, pieces

# The kinds in their order, and the base patterns. Digit runs are entered at their start only and never
# given back, which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider candidates, which the votes decide on: written-out addresses, eight-group addresses, numbers without a plus sign.
LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]{1,63}){1,8}")
AT = re.compile(r"[\[({](?:at|AT)[\])}]")  # what any written-out address holds
LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

# Gazetteers and cue words: fixed values.
ENDINGS = frozenset("com org net edu gov io co info biz de fr es uk eu us ca au jp in it nl ch at be se no pl br mx ru cn".split())
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "2221", "2720")
CUES = {
    "email": frozenset("email mail e-mail contact write reach correo courriel kontakt".split()),
    "ip": frozenset("ip host server address login client from adresse".split()),
    "card": frozenset("card visa mastercard credit debit payment karte carte tarjeta number".split()),
    "phone": frozenset("call phone tel telephone mobile fax whatsapp telefon telefono appelez".split()),
}
AGAINST = frozenset("version v isbn issn doi rev build release section figure table page token sha md5 hash order invoice id".split())
NEAR = 40
WORDS = re.compile(r"[A-Za-z][A-Za-z-]*")

ABSTAIN, NO, YES = 0, 1, 2
LABELERS = 6


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each has one @, so it begins where the run of allowed characters before that @ does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) of the base patterns, in order) and the card-like numbers of 13 to 19 digits that fail the check sum."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    failed = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19:
            if luhn(d):
                out.append((m.start(), 2, m.end()))
            elif len(d) >= 13:
                failed.append((m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out), failed


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind, end, base, key) in order: base spans, and wider candidates that overlap none; key is what votes on it say."""
    base, failed = base_spans(text)
    more = [(s, 2, e) for s, e in failed]
    if AT.search(text):
        more += [(m.start(), 0, m.end()) for m in LOOSE_EMAIL.finditer(text)]
    if ":" in text:
        more += [(m.start(), 1, m.end()) for m in LOOSE_IP.finditer(text)]
    more += [(m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(text)]
    out = [(s, k, e, True) for s, k, e in base]
    starts, far = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]
    for s, k, e in sorted(more):
        if far[bisect_left(starts, e)] <= s:  # no base span that begins before e ends after s
            out.append((s, k, e, False))
    return [(s, k, e, b, _key(text, s, k, e)) for s, k, e, b in sorted(out)]


def _key(text: str, s: int, k: int, e: int) -> str:
    """The kind, the labelers' votes and two shapes (length, share of digits), one character each."""
    span, kind = text[s:e], KINDS[k]
    d = _digits(span)
    around = {w.lower() for w in WORDS.findall(text[max(0, s - NEAR) : s]) + WORDS.findall(text[e : e + NEAR])}
    yes = lambda x: YES if x else NO
    joined = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
    if kind == "email":
        end = re.split(r"[.\s\])}]", span)[-1].lower()
        votes = [yes(end.isalpha() and len(end) >= 2), yes(".." not in span and not span.startswith(".")), yes(end in ENDINGS)]
    elif kind == "ip":
        parts = span.split(".")
        votes = [yes(len(parts) == 4 and all(p == "0" or p[0] != "0" for p in parts) if ":" not in span else "::" not in span), yes(s == 0 or text[s - 1] not in "vV.")]
        votes.append(NO if span.startswith(("0.", "1.0.", "1.1.1", "1.2.3")) else ABSTAIN)
    elif kind == "card":
        groups = re.split("[ -]", span)
        votes = [yes(len(groups) == 1 or {len(g) for g in groups[:-1]} <= {4, 6}), yes(luhn(d)), yes(d.startswith(ISSUERS) and 13 <= len(d) <= 19)]
    else:
        votes = [yes(10 <= len(d) <= 13), yes(any(c in span for c in " ().-")), yes(d.lstrip("0").startswith(DIALLING)) if span[0] == "+" or d.startswith("00") else ABSTAIN]
    votes += [YES if around & CUES[kind] else ABSTAIN, NO if around & AGAINST else ABSTAIN, yes(not joined)]
    shape = f"{min(9, (e - s) // 4)}{min(9, 10 * len(d) // (e - s))}"
    return str(k) + "".join(map(str, votes)) + shape


def reliabilities(patterns: dict[str, int], steps: int = 60) -> dict[str, float]:
    """P(personal) of each vote pattern (kind and votes) by expectation-maximisation, kind by kind.

    Each labeler has a chance of each vote given the truth, smoothed, and votes are independent given the truth; the start
    is the share of yes among the votes, so that the better side is the one that labelers tend to affirm.
    """
    out: dict[str, float] = {}
    for k in sorted({p[0] for p in patterns}):
        own = sorted(p for p in patterns if p[0] == k)
        votes = np.array([[int(c) for c in p[1 : 1 + LABELERS]] for p in own])
        n = np.array([float(patterns[p]) for p in own])
        cast = (votes != ABSTAIN).sum(1)
        p = ((votes == YES).sum(1) + 0.5) / (cast + 1)
        for _ in range(steps):
            prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
            odds = np.full(len(own), np.log(prior / (1 - prior)))
            for c in range(LABELERS):
                for v in (ABSTAIN, NO, YES):
                    hit = votes[:, c] == v
                    true = ((n * p)[hit].sum() + 1) / ((n * p).sum() + 3)
                    false = ((n * (1 - p))[hit].sum() + 1) / ((n * (1 - p)).sum() + 3)
                    odds[hit] += np.log(true / false)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if (n * p * ((votes == YES).sum(1) - (votes == NO).sum(1))).sum() * 2 < (n * ((votes == YES).sum(1) - (votes == NO).sum(1))).sum() * min(1.0, (n * p).sum() / n.sum()):
            p = 1 - p  # the classes changed names
        out |= {a: float(b) for a, b in zip(own, p, strict=True)}
    return out


def train(counts: dict[str, int]) -> dict[str, float]:
    """P(personal) of each key: a logistic regression on kind, votes and shape, trained on the votes' EM probabilities."""
    if not counts:
        return {}
    patterns: dict[str, int] = {}
    for key, n in counts.items():
        patterns[key[: 1 + LABELERS]] = patterns.get(key[: 1 + LABELERS], 0) + n
    soft = reliabilities(patterns)
    keys = sorted(counts)
    names = sorted({(key[0], at, c) for key in keys for at, c in enumerate(key)})
    column = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for i, key in enumerate(keys):
        for at, c in enumerate(key):
            x[i, column[key[0], at, c]] = 1
    n = np.array([float(counts[key]) for key in keys])
    beta = logistic(x, np.array([soft[key[: 1 + LABELERS]] for key in keys]), n / n.sum() * min(n.sum(), 1e5), ridge=1.0)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist(), strict=True))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> tuple[DataFrame, dict[str, float]]:
    """(the rows of docs with spans: array<struct<start, kind, end, base, key>> of all candidates in place of the text's reading, the classifier).

    Texts are scanned once, whole; null is empty. What the driver gets is one count per kind, vote pattern and shape: at most
    4 * 3^6 * 100 numbers however many rows there are.
    """
    kind = dict(docs.dtypes)[id_col]

    def make(cols):
        return {"doc_id": cols["doc_id"], "found": [[{"start": s, "kind": k, "end": e, "base": b, "key": key} for s, k, e, b, key in candidates(t or "")] for t in cols["text"].to_pylist()]}

    found = cut(in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, found array<struct<start:bigint,kind:int,end:bigint,base:boolean,key:string>>"))
    counts = found.select(F.explode("found.key").alias("key")).groupBy("key").count()
    return found, train({r["key"]: r["count"] for r in counts.collect()})


def decide(key_to_p: dict[str, float], threshold: float = 0.9) -> Callable[[bool, str], bool]:
    """Whether a candidate is a span: base ones are, others if the classifier says so."""
    good = {key for key, p in key_to_p.items() if p >= threshold}
    return lambda base, key: base or key in good


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256, spans (all, as kind:start:end by start and kind), n_added.

    Places are code points, ends exclusive. Null and empty texts have no spans, and the hash of the empty string. Spans of
    one start are in the order of their kinds. Rows that repeat an id or a text have a result each, and each counts in the
    fit; other columns, whatever their names, are ignored.
    """
    found, model = find_spans(docs, id_col, text_col, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(cols):
        take = decide(shared.value, threshold)
        out = {n: [] for n in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")}
        out["doc_id"] = cols["doc_id"]
        name = lambda x: f"{KINDS[x['kind']]}:{x['start']}:{x['end']}"
        for row in cols["found"].to_pylist():
            base = [x for x in row if x["base"]]
            kept = [x for x in row if take(x["base"], x["key"])]
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(x["kind"] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(",".join(map(name, base)).encode()).hexdigest())
            out["spans"].append(",".join(map(name, kept)))
            out["n_added"].append(len(kept) - len(base))
        return out

    kind = dict(docs.dtypes)[id_col]
    return in_arrow(found, make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """docs with every span in the text replaced by <kind>; rows, other columns and null texts stay as they are.

    The texts are scanned twice, once for the counts that the classifier needs and once to rewrite them, row by row, so that
    null and repeated ids don't matter.
    """
    by_row = docs.select(F.lit(0).alias("__row"), F.col(text_col))

    def keys(cols):
        return {"key": [key for t in cols["text"].to_pylist() for *_, key in candidates(t or "")]}

    counts = in_arrow(by_row.select(F.col(text_col).alias("text")), keys, "key string").groupBy("key").count()
    shared = docs.sparkSession.sparkContext.broadcast(train({r["key"]: r["count"] for r in counts.collect()}))
    names, at = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"`c{k}` {t}" for k, (_, t) in enumerate(docs.dtypes))

    def task(batches):
        import pyarrow as pa

        take = decide(shared.value, threshold)
        for piece in (p for batch in batches for p in pieces(batch)):
            texts = [None if (t := x.as_py()) is None else rewritten(t, take) for x in piece.column(at)]
            arrays = list(piece.columns)
            arrays[at] = pa.array(texts, piece.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=piece.schema)

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(task, schema).toDF(*names)


def rewritten(text: str, take: Callable[[bool, str], bool]) -> str:
    """The text with <kind> for each span; of overlapping spans the union goes under the first one's kind."""
    out, end = [], 0
    for s, k, e, base, key in candidates(text):
        if take(base, key):
            if s >= end:
                out += [text[end:s], f"<{KINDS[k]}>"]
            end = max(end, e)
    return "".join([*out, text[end:]])
