"""Personal data by weak supervision.

Patterns find base spans (email, ip, card, phone) and looser candidates. Labelers vote for or against each candidate, or
abstain: the pattern's strictness, a checksum, a gazetteer, words before it, words that speak against it, its edges. Votes
with the candidate's kind and features that no labeler sees - its length, what stands before it, whether a label's mark leads
it, how many kinds of characters it mixes - make one of a bounded number of patterns, which Spark counts over all documents.
Expectation-maximisation over the votes' counts estimates how often each labeler votes each way on true and false candidates, and
its posteriors train the final span classifier, a logistic regression on kind, votes and features. Base spans always stay; a looser candidate that
overlaps none of them is added if the classifier accepts it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm.common import cut, table

BASE = ("email", "ip", "card", "phone")
LOOSE = ("email_spelled", "ipv6", "card_unchecked", "phone_local", "ssn", "iban")
KINDS = BASE + LOOSE

_SOME = re.compile(r"[0-9@]|\[at\]|\(at\)")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each takes one pass: a run can't be entered in its middle, and possessive runs don't give back.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z]{2,10}\b")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+)(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches; each @ is looked at once, from the run of characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    return out


def digits_of(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(part: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-3:] if len(x.lstrip("0")) <= 3 else 999) <= 255 for x in part.split("."))


def base_spans(text: str) -> list[list[Span]]:
    """Spans of email, ip, card and phone."""
    if not _SOME.search(text):
        return [[], [], [], []]
    found = [emails(text), [], [], []]
    if _DIGIT.search(text):
        found[1] = [m.span() for m in _IP.finditer(text) if _octets(m[0])]
        found[2] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def _iban_ok(part: str) -> bool:
    return int("".join(str(int(c, 36)) for c in part[4:] + part[:4])) % 97 == 1


def loose_spans(text: str, taken: list[Span]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser candidates, none over a base span."""
    if not _SOME.search(text):
        return []
    found = []
    if "at" in text or "AT" in text:
        found += [(4, *m.span()) for m in _SPELLED.finditer(text)] if re.search(r"[\[(](?:at|AT)[\])]", text) else []
    if _DIGIT.search(text):
        found += [(5, *m.span()) for m in _IPV6.finditer(text)] if ":" in text else []
        found += [(6, *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19]
        found += [(7, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        found += [(8, *m.span()) for m in _SSN.finditer(text)] if "-" in text else []
        found += [(9, *m.span()) for m in _IBAN.finditer(text)]
    taken, out, at, done = sorted(taken), [], 0, 0
    reach = 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if a >= reach and a >= done:
            out.append((kind, a, b))
            done = b
    return out


# Gazetteers: fixed values.
_ENDINGS = frozenset("com net org edu gov info io de fr es uk it nl eu us ca ch at be pl pt".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR IE IT LU NL NO PL PT SE".split())
_FOR = re.compile(r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|mastercard|pay|ip|host|server|address|ssn|social|iban|account|konto|courriel|correo)\b[^\n]{0,24}\Z")
_AGAINST = re.compile(r"(?i)\b(?:version|release|build|section|figure|fig|isbn|issn|order|sku|part|ref|chapter|page|serial|example)\b[^\n]{0,12}\Z")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "counter_context", "edges")
#: Features and how many values each has.
FEATURES = (("length", 4), ("before", 3), ("led", 2), ("mixed", 3))
_LED = re.compile(r"[:=#]\x20*\Z|\b(?:is|ist|est|es)\x20\Z")


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """1 for, 0 abstains, -1 against: one for each of LABELERS."""
    part = text[start:end]
    digits = digits_of(part)
    name = KINDS[kind]
    pattern = 1 if kind < len(BASE) else 0
    checksum = gazetteer = 0
    if name == "email":
        gazetteer = 1 if part.rpartition(".")[2].lower() in _ENDINGS else -1
    elif name == "email_spelled":
        gazetteer = 1 if re.split(r"[.\])\x20]", part)[-1].lower() in _ENDINGS else -1
    elif name == "ip":
        head = part.split(".")
        checksum = -1 if any(len(x) > 1 and x[0] == "0" for x in head) else 1
        gazetteer = -1 if head[0] in ("0", "10", "127", "255") or head[:2] == ["192", "168"] else 1
    elif name == "ipv6":
        checksum = 1
    elif name in ("card", "card_unchecked"):
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_ISSUERS) else -1
    elif name == "phone":
        gazetteer = 1 if digits.startswith(_CALLING) else -1
    elif name == "phone_local":
        gazetteer = -1 if digits[0] in "01" else 1
    elif name == "ssn":
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif name == "iban":
        checksum = 1 if _iban_ok(part) else -1
        gazetteer = 1 if part[:2] in _COUNTRIES else -1
    before = text[max(0, start - 48) : start]
    context = 1 if _FOR.search(before) else 0
    counter = -1 if _AGAINST.search(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1
    return pattern, checksum, gazetteer, context, counter, edges


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Values of FEATURES of a candidate: eights of characters; start or blank, a mark, or a letter or digit before it; whether a
    colon, an equals sign or a verb leads it; how many of letters, digits and marks it has."""
    part, left = text[start:end], text[start - 1 : start]
    before = 0 if not left or left.isspace() else 2 if left.isalnum() else 1
    mixed = any(c.isalpha() for c in part) + any(c.isdigit() for c in part) + any(not c.isalnum() for c in part)
    return min(3, (end - start) // 8), before, int(bool(_LED.search(text[max(0, start - 8) : start]))), mixed - 1


def encode(kind: int, feature: tuple[int, ...], vote: tuple[int, ...]) -> int:
    code = kind
    for (_, many), f in zip(FEATURES, feature, strict=True):
        code = code * many + f
    for v in vote:
        code = code * 3 + v + 1
    return code


def decode(code: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    vote, feature = [], []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vote.append(v - 1)
    for _, many in reversed(FEATURES):
        code, f = divmod(code, many)
        feature.append(f)
    return code, tuple(reversed(feature)), tuple(reversed(vote))


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the posterior that a candidate with that code is true, by expectation-maximisation over the labelers' votes.

    Labelers vote independently given the truth; each has a rate for each vote and truth. Each kind has a rate of true ones.
    The first guess is the votes' sum. Every rate is smoothed by one count.
    """
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[c] for c in codes.tolist()], float)
    parts = [decode(c) for c in codes.tolist()]
    kinds = np.array([p[0] for p in parts])
    vote = np.array([p[2] for p in parts]).reshape(-1, len(LABELERS)) + 1
    belief = 1 / (1 + np.exp(-(vote - 1).sum(axis=1) + 0.5))
    for _ in range(rounds):
        log_odds = np.zeros(len(codes))
        for k in np.unique(kinds):
            w, b = weight[kinds == k], belief[kinds == k]
            log_odds[kinds == k] = np.log((w @ b + 1) / (w @ (1 - b) + 1))
        for j in range(len(LABELERS)):
            true, false = (np.bincount(vote[:, j], weight * b, 3) + 1 for b in (belief, 1 - belief))
            log_odds += (np.log(true / true.sum()) - np.log(false / false.sum()))[vote[:, j]]
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return codes, belief


def _inputs(codes: np.ndarray) -> np.ndarray:
    """One column for each kind, value of a feature, labeler and vote, and a constant."""
    first = np.cumsum([len(KINDS), *[many for _, many in FEATURES]])
    rows = np.zeros((len(codes), int(first[-1]) + 3 * len(LABELERS) + 1))
    for n, c in enumerate(codes.tolist()):
        kind, feature, vote = decode(c)
        rows[n, kind] = rows[n, -1] = 1
        for at, f in zip(first.tolist(), feature, strict=False):
            rows[n, at + f] = 1
        for j, v in enumerate(vote):
            rows[n, int(first[-1]) + 3 * j + v + 1] = 1
    return rows


def train(counts: dict[int, int], steps: int = 60, ridge: float = 1.0) -> dict[int, float]:
    """Probability of each code by a logistic regression on the estimated posteriors (Newton steps over weighted codes)."""
    if not counts:
        return {}
    codes, belief = estimate(counts)
    x, weight = _inputs(codes), np.array([counts[c] for c in codes.tolist()], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - belief)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


_FOUND = "doc_id long, kinds array<int>, starts array<long>, ends array<long>, codes array<long>"


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([v for r in rows for v in r], kind))


def candidates(docs: DataFrame) -> DataFrame:
    """All candidates of each row of docs, base spans first: kinds, places and vote codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[list[int]]] = [[], [], [], []]
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = [(k, a, b) for k, some in enumerate(base_spans(text)) for a, b in some]
                spans += loose_spans(text, [(a, b) for _, a, b in spans])
                columns[0].append([k for k, _, _ in spans])
                columns[1].append([a for _, a, _ in spans])
                columns[2].append([b for _, _, b in spans])
                columns[3].append([encode(k, features(text, a, b), votes(text, k, a, b)) for k, a, b in spans])
            arrays = [_lists(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], ["doc_id", "kinds", "starts", "ends", "codes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, counts, base_sha256, spans and n_added of every row of docs (doc_id, text, ...).

    A null or empty text has no spans. Spans go by kind as listed in KINDS, then by start; looser kinds follow the base kinds.
    Whole texts are searched. Repeated rows each give a row and count as candidates of their own. Further columns of docs are
    left out. Spans that begin together are listed by their kind, then their end. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    found = cut(candidates(docs))
    counted = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    scores = train({r["code"]: r["n"] for r in counted})  # at most 524,880 codes, kinds by features by votes; few occur
    shared = spark.sparkContext.broadcast(frozenset(c for c, p in scores.items() if p >= accept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RESULT.replace(",", "").split()[::2]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, kinds, starts, ends, codes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                spans = list(zip(kinds, starts, ends, codes, strict=True))
                base = sorted(s for s in spans if s[0] < len(BASE))
                added = sorted(s for s in spans if s[0] >= len(BASE) and s[3] in shared.value)
                joined = [",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in some) for some in (base, base + added)]
                row = [doc_id, *[sum(s[0] == k for s in base) for k in range(len(BASE))], hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(added)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return found.mapInArrow(run, RESULT)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detect() over all documents."""
    return detect(table(spark, sf_dir, "documents"))
