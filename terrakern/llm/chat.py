"""Chat formatting: conversations of typed content parts as text of one template, with a loss mask, attachments and token counts.

A turn is a list of parts. A visitor writes each in its way: text with its control strings escaped; image, audio and document parts
as a placeholder, with a record of what it stands for and of how many tokens it grows to. All is columns: parts are visited inside
their row, turns are put in order by ranges of the sorted table, and a conversation is held in pieces, one for each range that it
reaches into, so that only what must be one text (a digest of a whole conversation) brings its pieces together.

    <s><|user|>[INST] text [/INST]<|assistant|>text</s>

A control string inside a text gets a backslash behind its first character, and so does every text that already looks like that; reading
takes one away. The loss mask covers what an assistant says, without the template's own strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakern.llm.common import in_pieces, table

#: The template.
BEGIN, TURN, SAID, ASK, ASKED, END, ATTACHED, CLOSED = "<s>", "<|", "|>", "[INST] ", " [/INST]", "</s>", "[ATT ", "]"
SPEAKER = "assistant"
#: What a control string is after its first character, with any number of backslashes between.
_CONTROL = r"([<\[])(\\*)(/?s>|\||/?INST\]|ATT )"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|\||/?INST\]|ATT )"
#: Files that a text refers to, as [label](file) or ![label](file), by the kind of their ending; the size follows a # if at all.
KINDS = {"image": "png|jpg|jpeg|gif|webp", "audio": "mp3|wav|ogg|flac", "document": "pdf|docx"}
REFERENCE = r"!?\[[^\[\]\n]*\]\([^()\s]+\.(?:" + "|".join(KINDS.values()) + r")(?:#[0-9x.]+)?\)"
#: Tokens of an image for each patch of 28 by 28 points, of audio for each second, of a document for each page; sizes where none is told.
PATCH, SECOND, PAGE = 28, 25, 1024
SIZES = {"image": (448.0, 448.0), "audio": (30.0, 1.0), "document": (1.0, 1.0)}
PART = "struct<kind: string, text: string, uri: string, across: double, down: double>"


def parts_of(text: Column) -> Column:
    """Typed parts of a text, in order: what stands between references, and each reference as an image, audio or document part, whose
    `text` is the reference as it was written. A null or empty text is one empty text part."""
    text = F.coalesce(text, F.lit(""))
    between = F.split(text, REFERENCE, -1)

    def part(kind: Column, said: Column, uri: Column, across: Column, down: Column) -> Column:
        return F.struct(kind.alias("kind"), said.alias("text"), uri.alias("uri"), across.cast("double").alias("across"), down.cast("double").alias("down"))

    def referred(said: Column) -> Column:
        uri = F.regexp_extract(said, r"\(([^()#]+)", 1)
        size = F.regexp_extract(said, r"#([0-9x.]+)\)$", 1)
        ending, kind = F.lower(F.regexp_extract(uri, r"\.([a-z0-9]+)$", 1)), F.lit(None).cast("string")
        for name, endings in KINDS.items():
            kind = F.when(ending.rlike(f"^(?:{endings})$"), F.lit(name)).otherwise(kind)
        return part(kind, said, uri, F.split_part(size, F.lit("x"), F.lit(1)).try_cast("double"), F.split_part(size, F.lit("x"), F.lit(2)).try_cast("double"))

    plain = lambda said: part(F.lit("text"), said, *[F.lit(None).cast(t) for t in ("string", "double", "double")])
    mixed = F.flatten(F.zip_with(between, F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda a, b: F.when(b.isNull(), F.array(plain(a))).otherwise(F.array(plain(a), referred(b)))))
    return F.when(text.rlike(REFERENCE), mixed).otherwise(F.array(plain(text)))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|$1\\>")


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"\|\\(\\*)>", "|$1>"))


def tokens_of(part: Column) -> Column:
    """How many tokens the placeholder of a part grows to; none for text. A size that is missing or not above 0 is the kind's usual one."""
    out = F.lit(0)
    for kind, unit in (("image", None), ("audio", SECOND), ("document", PAGE)):
        across, down = (F.when(part[c] > 0, part[c]).otherwise(F.lit(usual)) for c, usual in zip(("across", "down"), SIZES[kind], strict=True))
        n = F.ceil(across * unit) if unit else F.ceil(across / PATCH) * F.ceil(down / PATCH)
        out = F.when(part["kind"] == kind, n).otherwise(out)
    return out.cast("long")


def visited(parts: Column) -> Column:
    """(body, attachments) of a turn's parts: the body in order, and of each part that isn't text its kind, uri, source and tokens.

    A part of another kind than text, image, audio and document, or without one, is text; a null text is empty. What neighbouring
    texts are together is escaped, so a control string in two halves is one too. Until then a zero character and a letter
    stand for a placeholder, and for a zero character of the text itself.
    """
    attached = lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False))
    zero = {"\0" + kind[0]: f"{ATTACHED}{kind}{CLOSED}" for kind in KINDS} | {"\0t": "\0"}
    plain = lambda p: F.replace(F.coalesce(p["text"], F.lit("")), F.lit("\0"), F.lit("\0t"))
    body = escaped(F.array_join(F.transform(parts, lambda p: F.when(attached(p), F.concat(F.lit("\0"), F.substring(p["kind"], 1, 1))).otherwise(plain(p))), ""))
    for mark, shown in zero.items():
        body = F.replace(body, F.lit(mark), F.lit(shown))
    records = F.transform(F.filter(parts, attached), lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), F.coalesce(p["text"], F.lit("")).alias("source"), tokens_of(p).alias("n_tokens")))
    return F.struct(body.alias("body"), records.alias("attachments"))


def formatted(turns: DataFrame) -> DataFrame:
    """Pieces of the formatted conversations of turns (conv_id, turn, role, parts): conv_id, piece (rising along the conversation), n_turns,
    formatted, loss (begin and end of each masked stretch, in code points of the piece), attachments in order, each with `masked`.

    Turns go by number, null first, then role and body; a null role is empty, null parts are no parts. Rows that repeat are turns
    each. Rows without a conv_id are one conversation. Further columns are left out; texts may be of any length; an empty table has no
    pieces. A piece has 64 turns at the most; all pieces of a conversation in order are its text.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visited(F.coalesce("parts", F.array().cast(f"array<{PART}>"))).alias("v"))
    rows = in_pieces(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("v.body")])
    rows = rows.withColumn("piece", F.shiftright("_at", 6))
    speaks = F.col("role") == SPEAKER
    head = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit(SAID), F.when(speaks, F.lit("")).otherwise(F.lit(ASK)))
    tail = F.when(speaks, F.lit(END)).otherwise(F.lit(ASKED))
    rows = rows.select("conv_id", "piece", "_at", speaks.alias("speaks"), F.char_length(head).alias("head"), F.char_length("v.body").alias("long"), F.concat(head, "v.body", tail).alias("text"), "v.attachments")
    before = Window.partitionBy("conv_id", "piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)) + F.col("head")
    masked = F.transform("attachments", lambda a: a.withField("masked", F.col("speaks")))
    turn = F.struct("_at", "text", F.when(F.col("speaks"), F.struct(begin.alias("begin"), (begin + F.col("long")).alias("end"))).alias("span"), masked.alias("attachments"))
    pieces = rows.withColumn("t", turn).groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    opens = F.min("piece").over(Window.partitionBy("conv_id")) == F.col("piece")
    shift = F.when(F.col("opens"), F.lit(len(BEGIN))).otherwise(F.lit(0))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return pieces.withColumn("opens", opens).select(
        "conv_id", "piece", F.size("turns").cast("long").alias("n_turns"), F.concat(F.when(F.col("opens"), F.lit(BEGIN)).otherwise(F.lit("")), F.array_join(F.transform("turns", lambda t: t["text"]), "")).alias("formatted"),
        F.transform(spans, lambda s: F.struct((s["begin"] + shift).alias("begin"), (s["end"] + shift).alias("end"))).alias("loss"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )


def _restored(text: Column, attachments: Column) -> Column:
    """A formatted text with the source of each attachment, escaped, where its placeholder was."""
    between = F.split(text, r"\[ATT (?:" + "|".join(KINDS) + r")\]", -1)
    whole = F.zip_with(between, F.transform(attachments, lambda a: escaped(a["source"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(attachments) > 0, F.array_join(whole, "")).otherwise(text)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, turns (role and text of each, as they were before formatting) and loss_text (what the mask covers) of pieces."""

    def turn(t: Column) -> Column:
        role = F.substring_index(t, SAID, 1)
        rest = F.substring(t, F.char_length(role) + len(SAID) + 1, F.char_length(t))
        begin = F.when(role == SPEAKER, F.lit(0)).otherwise(F.lit(len(ASK)))
        end = F.when(role == SPEAKER, F.lit(len(END))).otherwise(F.lit(len(ASKED)))
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substring(rest, begin + 1, F.char_length(rest) - begin - end)).alias("text"))

    whole = F.split(_restored(F.col("formatted"), F.col("attachments")), r"<\|", -1)
    said = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))), "")
    loss = unescaped(_restored(said, F.filter("attachments", lambda a: a["masked"])))
    return pieces.select("conv_id", "piece", F.transform(F.slice(whole, 2, F.size(whole)), turn).alias("turns"), loss.alias("loss_text"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the template's own strings, formatted and read back. A digest of a whole conversation needs
    its text in one row; up to there no row has more than a piece."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(SPEAKER)).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = rows.unionByName(odd)
    pieces = formatted(rows.withColumn("parts", parts_of(F.col("text"))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(pieces.withColumnRenamed("piece", "number").withColumn("piece", F.struct("number", "n_turns", F.char_length("formatted").alias("chars"), F.size("attachments").alias("attached"), F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("tokens"))))
    read = read.select("conv_id", F.struct(F.col("piece.number"), lines.alias("said"), "loss_text").alias("p"), *[F.col(f"piece.{c}").alias(c) for c in ("n_turns", "chars", "attached", "tokens")])
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"), *[F.sum(c).alias(c) for c in ("n_turns", "chars", "attached", "tokens")])
    joined = lambda c: F.array_join(F.transform("p", lambda p: p[c]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.char_length(joined("loss_text")).cast("long").alias("loss_chars"), F.sha2(joined("loss_text"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"), F.col("attached").alias("n_attachments"), F.col("tokens").alias("attachment_tokens"),
    )
