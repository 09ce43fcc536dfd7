"""Secret scans in column expressions alone.

Base spans come from patterns. The method adds candidate strings that look random: over every window of WINDOW characters
the Shannon entropy of the characters is followed by incremental counts (one character enters, one leaves), and a candidate
is a secret when its highest window passes the bound of its character class, unless an allow-list entry covers it.

A place in the text isn't given by regexp_extract_all; splitting by the same pattern gives the gaps between the matches,
and running lengths of gaps and matches give the places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least characters. A whole run of [0-9a-f] or of [A-Z0-9] after AKIA is one match or none, so the least length may stand in the pattern.
BASE = (("assign", ASSIGN, 8), ("access", r"AKIA[A-Z0-9]{12,}", 16), ("hex", r"[0-9a-f]{32,}", 32))
METHOD = "entropy"

WINDOW = 20
#: A run of 20 characters or more that holds a digit or a capital; dots may join its parts. One pass over the text: a run is
#: entered at its start alone.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-]\.)(?=[a-z+/_=.-]*+[0-9A-Z])[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{18,}[A-Za-z0-9+/_=-]"
#: Class, pattern of all its characters, bits for each character that a window must reach. Letters alone must mix both cases as
#: chance does, or they are a name made of words; with dots, small letters, capitals and digits must all be there.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]*[0-9][0-9A-Fa-f]*$", 3.0),
    ("lower", r"^(?=.*[0-9])[0-9a-z_=-]+$", 3.6),
    ("upper", r"^(?=.*[0-9])[0-9A-Z_=-]+$", 3.6),
    ("letters", r"^(?=(?:[a-z]*[A-Z]){5})(?=(?:[A-Z]*[a-z]){5})[A-Za-z]+$", 3.7),
    ("base64", r"^(?=.*[0-9])[0-9A-Za-z+/_=-]+$", 3.8),
    ("dotted", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/_=.-]+$", 3.9),
)
#: Strings that look random and are no secrets: documentation keys, nil and example identifiers, hashes by name, data headers.
ALLOW = (r"(?i)example", r"(?i)^(https?:)?//|www\.", r"(?i)sample", r"(?i)placeholder", r"(?i)^sha(1|256|384|512)[-_]", r"^[0-9-]+$", r"^0+[1-9]?$", r"(?i)^(0123456789|abcdefghij)", r"^iVBORw0KGgo", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def spans(text: Column, pattern: str, kind: str, order: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, ord, kind, end>> of the leftmost non-overlapping matches that `keep` accepts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    made = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"

    def step(state: Column, i: Column) -> Column:
        hit = F.get(hits_and_gaps["hits"], i)
        start = state["at"] + F.length(F.get(hits_and_gaps["gaps"], i))
        end = start + F.length(hit)
        one = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.cast("long").alias("end")))
        out = F.concat(state["out"], one)
        if keep is not None:
            out = F.when(keep(hit), out).otherwise(state["out"])
        return F.struct(end.cast("long").alias("at"), out.alias("out"))

    # The lambda would evaluate split() again at each turn; through transform() over one element it is evaluated once.
    hits_and_gaps = None

    def once(pair: Column) -> Column:
        nonlocal hits_and_gaps
        hits_and_gaps = pair
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(made).alias("out"))
        turns = F.when(F.size(pair["hits"]) > 0, F.sequence(F.lit(0), F.size(pair["hits"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(turns, start, step)["out"]

    found = F.flatten(F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), once))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(made))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of the windows of `window` characters; of the whole string where it is shorter.

    With counts c over w characters, H = log2(w) - sum(c * log2(c)) / w. Each turn takes one character in and one out and changes
    the sum by their two counts, which are read off the window itself, so the state is two numbers. A character outside ASCII
    counts as code 127.
    """
    codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(127)))

    def fold(pair: Column) -> Column:
        chars, n = pair["codes"], F.size(pair["codes"])
        width = F.least(F.lit(window), n)

        def step(state: Column, i: Column) -> Column:
            new, full = F.get(chars, i), i >= width
            old = F.when(full, F.get(chars, i - width)).otherwise(F.lit(-1))
            before = F.slice(chars, F.greatest(i - width, F.lit(0)) + 1, F.least(i, width))  # the window that the last turn left
            had, left = F.size(F.filter(before, lambda c: c == new)), F.size(F.filter(before, lambda c: c == old))
            gain = F.when(old == new, F.lit(0.0)).otherwise(_c_log_c(had + 1) - _c_log_c(had) + F.when(full, _c_log_c(left - 1) - _c_log_c(left)).otherwise(F.lit(0.0)))
            total = state["sum"] + gain
            bits = F.log2(width.cast("double")) - total / width
            return F.struct(total.alias("sum"), F.when(i >= width - 1, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["best"]).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(F.struct(codes.alias("codes"))), fold), F.lit(0))


def looks_random(string: Column, window: int = WINDOW, classes: Sequence = CLASSES, allow: Sequence[str] = ALLOW) -> Column:
    """Whether a candidate passes the bound of the first class that holds all its characters and no allow-list entry fits it."""
    bound = F.lit(99.0)
    for _, pattern, bits in reversed(classes):
        bound = F.when(string.rlike(pattern), F.lit(bits)).otherwise(bound)
    out = (F.length(string) >= window) & string.rlike("[A-Za-z]")
    for pattern in allow:
        out = out & ~string.rlike(pattern)
    return F.when(out, window_entropy(string, window) >= bound).otherwise(F.lit(False))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every row of docs (doc_id, text, ...).

    A null or empty text has no spans, and the sha256 of no bytes. Spans go by start, then by kind in the order assign,
    access, hex, entropy. An entropy span that lies within a base span isn't added. Whole texts are scanned. Repeated rows
    each give a row. Further columns of docs are left out. Spans that begin together stand in the kinds' order. An empty table
    gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    found = {}
    for n, (kind, pattern, least) in enumerate(BASE):
        keep = None
        if kind == "assign":
            keep = lambda hit, pattern=pattern, least=least: F.length(F.regexp_extract(hit, pattern, 2)) >= least
        found[kind] = spans(F.col("text"), pattern, kind, n, keep)
    method = spans(F.col("text"), CANDIDATE, METHOD, len(BASE), looks_random)
    rows = rows.select("doc_id", *[c.alias(f"_{k}") for k, c in found.items()], method.alias("_method"))
    base = F.array_sort(F.concat(*[F.col(f"_{k}") for k in found]))
    added = F.filter("_method", lambda m: ~F.exists("_base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    rows = rows.withColumn("_base", base).withColumn("_added", added)
    return rows.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in found],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
        F.size("_added").cast("long").alias(f"n_{METHOD}"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over all documents."""
    return scan(table(spark, sf_dir, "documents"))
