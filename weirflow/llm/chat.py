"""Chat formatting with typed content parts, in built-in functions only.

A turn's content is a list of parts. A visitor flattens text, image, audio and
document parts in order: text is escaped, any other part becomes its kind's
placeholder with a reference to the attachment and its expanded token count.

Null text, role or content counts as empty. Turns go by number, then role, then
text as it was given; turns with equal numbers are all kept. A null conversation id is a
conversation of its own. A part of unknown kind is treated as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Control strings of this and other common templates: a backslash goes before their second part.
_CONTROL = r"(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(\||s>|/s>|INST\]|/INST\])"


@dataclass(frozen=True)
class Template:
    turn: str = "<|turn|>"
    end: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    trained_role: str = "assistant"
    patch: int = 28  # pixels of an image token's side
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in (("[", "%5B"), ("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def as_parts(text: Column) -> Column:
    """A content of one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def _media(part: Column, t: Template) -> Column:
    """Kind, reference and expanded tokens of a part that is not text."""
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(t.patch)) / F.lit(t.patch)).cast("int")
    tokens = (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(t.audio_rate)).cast("int"))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * F.lit(t.page_tokens))
    )
    return F.struct(part["type"].alias("kind"), F.coalesce(part["ref"], F.lit("")).alias("ref"), tokens.alias("tokens"))


_SEEN = "struct<texts:array<string>,media:array<struct<kind:string,ref:string,tokens:int>>>"


def _visit(content: Column, t: Template) -> Column:
    """Parts in order: the texts before, between and after the attachments, and the attachments.

    Texts that follow one another are one text, so no control string can be
    put together from parts that hold none.
    """
    nothing = F.struct(F.array(F.lit("")).alias("texts"), F.array().alias("media")).cast(_SEEN)

    def step(seen: Column, part: Column) -> Column:
        media = F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))
        last = F.size(seen["texts"])
        text = F.concat(F.element_at(seen["texts"], -1), F.coalesce(part["text"], F.lit("")))
        with_text = F.struct(F.concat(F.slice(seen["texts"], F.lit(1), last - 1), F.array(text)).alias("texts"), seen["media"].alias("media"))
        with_media = F.struct(F.concat(seen["texts"], F.array(F.lit(""))).alias("texts"), F.concat(seen["media"], F.array(_media(part, t))).alias("media"))
        return F.when(media, with_media.cast(_SEEN)).otherwise(with_text.cast(_SEEN))

    return F.aggregate(content, nothing, step)


def _body(turn: Column, t: Template) -> Column:
    """Escaped texts with the placeholders between them."""
    mark = lambda m: F.when(m["kind"] == "image", F.lit(t.image)).when(m["kind"] == "audio", F.lit(t.audio)).otherwise(F.lit(t.document))
    marks = F.concat(F.transform(turn["media"], mark), F.array(F.lit("")))
    return F.array_join(F.zip_with(turn["texts"], marks, lambda text, m: F.concat(escape(text), m)), "")


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation from ``conv_id, turn, role, content`` (a list of ``PART``).

    ``formatted``: all turns; ``loss_mask``: for each turn the characters to
    ``skip``, to ``take`` (trained on) and the ``rest``, which together run
    through ``formatted``; ``attachments``: turn, kind, ref and tokens of each
    placeholder in order; ``expanded_tokens``: their sum.
    """
    t = template
    role = F.coalesce(F.col("role"), F.lit(""))
    content = F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>"))
    seen = turns.select("conv_id", "turn", role.alias("role"), _visit(content, t).alias("seen"))
    entry = F.struct("turn", "role", F.col("seen.texts").alias("texts"), F.col("seen.media").alias("media"))
    chats = seen.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"))

    def rendered(x: Column) -> Column:
        return F.struct(x["turn"].alias("turn"), F.concat(F.lit(t.turn), _role_out(x["role"]), F.lit("\n")).alias("head"), _body(x, t).alias("body"), (x["role"] == t.trained_role).alias("trained"), x["media"].alias("media"))

    def mask(x: Column) -> Column:
        size = F.length(x["body"])
        return F.struct(
            (F.length(x["head"]) + F.when(x["trained"], 0).otherwise(size)).cast("bigint").alias("skip"),
            F.when(x["trained"], size).otherwise(0).cast("bigint").alias("take"),
            F.lit(len(t.end)).cast("bigint").alias("rest"),
        )

    chats = chats.select("conv_id", F.transform("turns", rendered).alias("turns"))
    media = F.flatten(F.transform("turns", lambda x: F.transform(x["media"], lambda m: F.struct(x["turn"].alias("turn"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(t.end))), "").alias("formatted"),
        F.transform("turns", mask).alias("loss_mask"),
        media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column, loss_mask: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: ``role``, ``text`` and ``trained`` (what the mask takes), unescaped."""
    t = template
    cuts = F.split(formatted, r"\Q" + t.turn + r"\E")
    whole = F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0)))

    def read(turn: Column, mask: Column) -> Column:
        head = F.substring_index(turn, "\n", 1)
        text = turn.substr(F.length(head) + 2, F.length(turn) - F.length(head) - 1 - len(t.end))
        took = turn.substr((mask["skip"] - len(t.turn) + 1).cast("int"), mask["take"].cast("int"))
        return F.struct(_role_in(head).alias("role"), unescape(text).alias("text"), unescape(took).alias("trained"))

    return F.zip_with(whole, loss_mask, read)
