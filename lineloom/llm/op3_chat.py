"""Chat formatting of messages with typed content parts.

A message's content is plain text, or a JSON list of parts ({"type": "text" | "image" | "audio" | "document", ...}), or
text with Markdown attachments (![alt](reference), told apart by their extension). A visitor walks the parts in order and
flattens them: text stays, an attachment becomes the placeholder of its kind, its reference is recorded in order, and the
tokens it expands to are counted (an image by patches, audio by seconds, a document by pages). Text is counted with a
public tokenizer whose file is a parameter. Turns of a conversation follow in the order of turn, then role and content.

A literal "<|" in a text is written "< |", so no text can forge a marker. Null content is a turn without text, a null role
is "unknown", a null turn sorts first (ties by role, then content); each row with a null conv_id is a conversation of its
own with a null id, so that they don't gather in one row. A JSON list that is not a list of typed parts is plain text; a
part of unknown type is kept as its JSON text. Repeated rows are repeated turns. A conversation is one row, and a very long
text is tokenized whole: a task holds the conversation at hand. Other columns, whatever their names, are ignored. No rows:
an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared

#: The tokenizer's file where neither the parameter nor the setting CONF names one.
TOKENIZER, CONF = "/opt/tokenizers/byte_bpe_50k.json", "spark.lineloom.tokenizer"
PATCH, IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS, TURN_TOKENS = 28, 448, 25, 560, 3
LINK = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]+)\)")
KINDS = {"png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "wav": "audio", "mp3": "audio", "flac": "audio", "ogg": "audio", "pdf": "document", "docx": "document", "txt": "document"}


@dataclass
class Text:
    text: str

    def accept(self, visitor):
        visitor.text(self)


@dataclass
class Image:
    ref: str
    width: int | None = None
    height: int | None = None

    def accept(self, visitor):
        visitor.image(self)


@dataclass
class Audio:
    ref: str
    seconds: float | None = None

    def accept(self, visitor):
        visitor.audio(self)


@dataclass
class Document:
    ref: str
    pages: int | None = None

    def accept(self, visitor):
        visitor.document(self)


def _number(x, default=None):
    return x if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and x >= 0 else default


def _ref(part: dict, *names: str) -> str:
    """The reference of an attachment part: a string, or a {"url": ...} below one of the names."""
    for name in (*names, "url", "ref", "file_id", "data"):
        x = part.get(name)
        x = x.get("url", x.get("ref", x.get("file_id"))) if isinstance(x, dict) else x
        if isinstance(x, str):
            return x
    return ""


def _typed(part: dict):
    kind = part.get("type")
    if kind in ("text", "input_text", "output_text") and isinstance(part.get("text"), str):
        return Text(part["text"])
    if kind in ("image", "image_url", "input_image"):
        return Image(_ref(part, "image_url", "image"), _number(part.get("width")), _number(part.get("height")))
    if kind in ("audio", "audio_url", "input_audio"):
        return Audio(_ref(part, "audio_url", "input_audio", "audio"), _number(part.get("seconds")))
    if kind in ("document", "file", "input_file"):
        return Document(_ref(part, "document", "file"), _number(part.get("pages")))
    return Text(json.dumps(part, ensure_ascii=False, sort_keys=True))


def parts(content: str | None) -> list:
    """Typed parts of a message's content."""
    if not content:
        return []
    if content.lstrip()[:1] == "[":
        try:
            given = json.loads(content)
        except (ValueError, RecursionError):
            given = None
        if isinstance(given, list) and given and all(isinstance(x, dict) and "type" in x for x in given):
            return [_typed(x) for x in given]
    out, at = [], 0
    for m in LINK.finditer(content) if "![" in content else ():
        kind = KINDS.get(re.split(r"[?#]", m[2])[0].rpartition(".")[2].lower())
        if kind:
            out += [Text(content[at : m.start()])] if m.start() > at else []
            out.append({"image": Image, "audio": Audio, "document": Document}[kind](m[2]))
            at = m.end()
    return out + ([Text(content[at:])] if at < len(content) else [])


@dataclass
class Flattener:
    """Visitor that turns parts into text with placeholders, attachment records and the texts to be counted."""

    rendered: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def text(self, part: Text) -> None:
        safe = part.text.replace("<|", "< |")
        self.rendered.append(safe)
        self.plain.append(safe)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.rendered.append(f"<|{kind}|>")
        self.attachments.append({"kind": kind, "ref": ref, "n_tokens": tokens})

    def image(self, part: Image) -> None:
        sides = [max(1, math.ceil((IMAGE_SIDE if x is None else x) / PATCH)) for x in (part.width, part.height)]
        self._attach("image", part.ref, sides[0] * sides[1])

    def audio(self, part: Audio) -> None:
        self._attach("audio", part.ref, math.ceil((part.seconds or 0) * AUDIO_RATE))

    def document(self, part: Document) -> None:
        self._attach("document", part.ref, math.ceil(PAGE_TOKENS * (1 if part.pages is None else part.pages)))


def flatten(content: str | None) -> Flattener:
    visitor = Flattener()
    for part in parts(content):
        part.accept(visitor)
    return visitor


_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


_TURN = "conv_id long, turn long, role string, rendered string, n_text long, attachments array<struct<kind string, ref string, n_tokens long>>"


def _flattened(path: str):
    attachment = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                flat = [flatten(x) for x in rows.column("text").to_pylist()]
                texts = [x for f in flat for x in f.plain]
                sizes = iter([len(e) for e in tok.encode_batch(texts, add_special_tokens=False)])
                n_text = [sum(next(sizes) for _ in f.plain) for f in flat]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("conv_id"), rows.column("turn"), rows.column("role"), pa.array(["".join(f.rendered) for f in flat], pa.string()), pa.array(n_text, pa.int64()), pa.array([f.attachments for f in flat], attachment)],
                    ["conv_id", "turn", "role", "rendered", "n_text", "attachments"],
                )

    return run


def chats(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, n_turns, text, n_text_tokens, n_attachment_tokens, n_tokens, attachments) of every conversation.

    n_tokens adds TURN_TOKENS a turn for its markers. attachments holds kind, ref and n_tokens in the order of the
    placeholders.
    """
    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    path = tokenizer or conversations.sparkSession.conf.get(CONF, TOKENIZER)
    flat = shared.small_batches(rows).mapInArrow(shared.lean(_flattened(path)), _TURN).withColumn("role", F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"<\|", "< |"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = flat.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "rendered", "n_text", "attachments"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["rendered"], F.lit("<|end|>\n"))), "")
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + f(x))
    out = turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), text.alias("text"), total("t", lambda t: t["n_text"]).alias("n_text_tokens"), F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"))
    out = out.withColumn("n_attachment_tokens", total("attachments", lambda a: a["n_tokens"]))
    return out.select("conv_id", "n_turns", "text", "n_text_tokens", "n_attachment_tokens", (F.col("n_text_tokens") + F.col("n_attachment_tokens") + F.lit(TURN_TOKENS) * F.col("n_turns")).alias("n_tokens"), "attachments")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
