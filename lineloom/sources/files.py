"""Files as tables: transcripts by page and line, images, HTML tables, box files; and the sinks that write them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.errors import BadImage, BadInput
from lineloom.functions import text

NAME = r"([0-9a-fA-F]+)/([0-9a-fA-F]+)\.([^/]*)$"


def path_keys(path: Column) -> list[Column]:
    """book, page_no, line_id (hexadecimal, as segmenters write it), base and kind of a file name like book/0001/010002.gt.txt."""
    number = lambda k: F.conv(F.regexp_extract(path, NAME, k), 16, 10).cast("long")
    base = F.regexp_replace(path, r"\.[^/]*$", "")
    return [F.regexp_extract(path, r"([^/]+)/[0-9a-fA-F]+/[^/]*$", 1).alias("book"), number(1).alias("page_no"), number(2).alias("line_id"), base.alias("base"), F.regexp_extract(path, r"[^/.]\.([^/]*)$", 1).alias("kind")]


def transcripts(spark: SparkSession, paths: str | list[str], normalize: bool = True) -> DataFrame:
    """(path, book, page_no, line_id, base, kind, text): one row a file, its last newline off, text normalised.

    A path that matches nothing is an error.
    """
    raw = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    body = F.regexp_replace("value", "\n$", "")
    return raw.select("path", *path_keys(F.col("path")), (text.normalize_text(body) if normalize else body).alias("text"))


def files_listed(spark: SparkSession, list_file: str) -> list[str]:
    """File names from a list file, one a line, blank lines and # comments left out; a reader needs its paths on the driver."""
    return [r["value"] for r in spark.read.text(list_file).where("trim(value) <> '' and not startswith(value, '#')").collect()]


def transcript_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(page_no, line_id, text) from lines "NNNN.HHHHHH text"; other lines are left out."""
    at = lambda k: F.regexp_extract(column, r"^([0-9a-fA-F]{4})\.([0-9a-fA-F]{6})\s+(.*)$", k)
    return lines.where(at(1) != "").select(F.conv(at(1), 16, 10).cast("long").alias("page_no"), F.conv(at(2), 16, 10).cast("long").alias("line_id"), at(3).alias("text"))


def encode_png(a: np.ndarray) -> bytes:
    """A gray (0..1) or label (int, as RGB) image as PNG."""
    if a.ndim != 2:
        raise BadImage("an image has two axes")
    if a.dtype.kind == "f":
        rows, kind = np.rint(np.clip(a, 0, 1) * 255).astype(np.uint8), 0
    elif a.dtype == np.uint8:
        rows, kind = a, 0
    else:
        rows, kind = np.ascontiguousarray(a.astype(">u4")).view(np.uint8).reshape(*a.shape, 4)[..., 1:].reshape(a.shape[0], -1), 2
    body = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 1)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """8-bit gray as 0..1, RGB as integers, from a PNG without interlacing."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise BadImage("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        data += raw[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise BadImage("only plain 8-bit gray and RGB")
    w, h, c = head[0], head[1], 3 if head[3] else 1
    body = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    for y, row in enumerate(body):
        up = out[y - 1] if y else np.zeros(w * c, np.uint8)
        line = row[1:].copy()
        if row[0] == 2:
            line += up
        elif row[0]:
            for i in range(w * c):
                a, b, d = (int(line[i - c]) if i >= c else 0), int(up[i]), (int(up[i - c]) if i >= c else 0)
                p = a + b - d
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                line[i] = (int(line[i]) + {1: a, 3: (a + b) // 2, 4: best}[int(row[0])]) & 255
        out[y] = line
    if c == 1:
        return out / 255.0
    rgb = out.reshape(h, w, 3).astype(np.int64)
    return rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, height, width, data, error) of PNG files: gray row-major 0..1; what can't be read has only an error."""

    def run(parts):
        for part in parts:
            out = []
            for p, c in zip(part["path"], part["content"], strict=True):
                try:
                    a = decode_png(bytes(c)).astype(float)
                    out.append((p, *a.shape, a.ravel().tolist(), None))
                except (BadInput, ValueError, zlib.error, struct.error) as e:
                    out.append((p, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "height", "width", "data", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content").mapInPandas(run, "path string, height int, width int, data array<double>, error string")


def html_cells(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, table_no, row_no, text) of every table row, tags removed."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    return rows.select(key, "table_no", "row_no", F.trim(F.regexp_replace("r", "(?s)<[^>]*>", "")).alias("text"))


_CELL = "(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def line_name(page: Column, line: Column) -> Column:
    """NNNN.DDDDDDDDDD, as lists of transcripts name a line."""
    return F.format_string("%04d.%010d", page, line)


def correction_html(lines: DataFrame, by: list[str], height: int = 48) -> DataFrame:
    """(by, html): a page for each group of lines (name, image or null, text) in which the texts can be edited.

    Each line is a table of three rows, its name, its image as a data address and its text; no text is the empty text.
    """
    cell = lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td></tr>"))
    image = F.coalesce(F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("image"), r"\s", "")), F.lit(""))
    row = F.concat(F.lit("<table>"), cell(text.escape_html(F.col("name"))), cell(F.concat(F.lit("<img alt='line' src='"), image, F.lit(f"' height='{height}' />"))), F.lit("<tr><td contenteditable='true'>"), text.escape_html(F.coalesce("text", F.lit(""))), F.lit("</td></tr></table>\n"))
    pages = lines.select(*by, F.struct("name", row.alias("row")).alias("r")).groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r"))
    head = "<!DOCTYPE html>\n<html><head><meta charset='utf-8' /></head><body>\n"
    return pages.select(*by, F.concat(F.lit(head), F.array_join(F.transform("r", lambda r: r["row"]), ""), F.lit("</body></html>\n")).alias("html"))


def corrections(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, table_no, name, image, text) of every table of three rows or more: what correction_html wrote, edited or not.

    Only images given as data addresses are decoded; nothing is fetched.
    """
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)).alias("r")).where(F.size("r") >= 3)
    plain = lambda k: text.unescape_html(F.regexp_replace(F.regexp_extract(F.get("r", F.lit(k)), _CELL, 1), "(?s)<[^>]*>", ""))
    return rows.select(key, "table_no", plain(0).alias("name"), data_uri(F.regexp_extract(F.get("r", F.lit(1)), r"""(?is)<img[^>]*\ssrc=['"]([^'"]*)""", 1)).alias("image"), plain(2).alias("text"))


def correction_text(lines: DataFrame) -> DataFrame:
    """(name, value): a line "name TAB text" for each, to be edited and read by transcript_list."""
    return lines.select("name", F.concat_ws("\t", "name", F.coalesce("text", F.lit(""))).alias("value"))


def correction_org(lines: DataFrame, file: str = "path") -> DataFrame:
    """(name, value): the same as an outline with a link to the image above each line."""
    return lines.select("name", F.concat(F.lit(" " * 15 + "\t[["), F.col(file), F.lit("]]\n"), F.concat_ws("\t", "name", F.coalesce("text", F.lit(""))), F.lit("\n")).alias("value"))


def gallery(lines: DataFrame, page: str, most: int = 10, least: int = 20, width: int = 100) -> DataFrame:
    """(page, lines): of each page the first `most` texts, by line_id, of `least` characters or more, cut at `width`."""
    w = Window.partitionBy(page).orderBy("line_id")
    some = lines.where(F.length("text") >= least).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return some.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: F.substring(x["text"], 1, width)).alias("lines"))


def character_tables(read: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, pos, ch, x, p) from recognised lines with chars: what the location and probability tables list."""
    return read.select(key, F.posexplode("chars").alias("pos", "c")).select(key, "pos", "c.ch", "c.x", "c.p")


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """(path, bytes): each row's content (binary) as a file of its own below the folder, over an older one of that name.

    A name must be relative and not lead upwards. The folder must be one that executors share.
    """
    ok = ~(F.col(name).startswith("/") | F.col(name).rlike(r"(^|/)\.\.(/|$)"))

    def run(parts):
        from pyarrow import fs

        for part in parts:
            out = []
            for n, c in zip(part[name], part[content], strict=True):
                system, path = fs.FileSystem.from_uri(f"{folder}/{n}".replace("s3a://", "s3://", 1))
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path + ".part", compression=None) as f:
                    f.write(bytes(c))
                system.move(path + ".part", path)
                out.append((f"{folder}/{n}", len(c)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.where(ok & F.col(content).isNotNull()).select(name, content).mapInPandas(run, "path string, bytes long")


def with_siblings(lines: DataFrame, others: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """lines with each optional sibling's text in a column of its kind, null where a line has none."""
    out = lines
    for kind, rows in others.items():
        out = out.join(rows.select(*on, F.col("text").alias(kind)).dropDuplicates(on), on, "left")
    return out


def data_uri(col: Column) -> Column:
    """Bytes of a base64 data URI, null for any other address: nothing is fetched."""
    return F.when(col.rlike(r"^data:[^,]*;base64,"), F.unbase64(F.regexp_replace(col, r"^data:[^,]*,", "")))


def box_file(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ch, x0, y0, x1, y1, page_no) from lines "c x0 y0 x1 y1 page"; y counted from below."""
    f = F.split(column, " ")
    return lines.where(F.size(f) >= 5).select(F.get(f, F.lit(0)).alias("ch"), *(F.get(f, F.lit(k + 1)).try_cast("int").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), F.coalesce(F.get(f, F.lit(5)).try_cast("int"), F.lit(0)).alias("page_no"))


def costs_file(lines: DataFrame, column: str = "value") -> DataFrame:
    """(segment, cost) from lines "segment cost"."""
    f = F.split(F.trim(column), r"\s+")
    return lines.where(F.size(f) >= 2).select(F.get(f, F.lit(0)).try_cast("long").alias("segment"), F.get(f, F.lit(1)).try_cast("double").alias("cost")).where("segment is not null")


def rewrites_file(lines: DataFrame, column: str = "value") -> DataFrame:
    """(op, src, dst, cost) from tab-separated lines."""
    f = F.split(column, "\t")
    return lines.where((F.size(f) == 4) & ~F.col(column).startswith("#")).select(*(F.get(f, F.lit(k)).alias(c) for k, c in enumerate(("op", "src", "dst"))), F.get(f, F.lit(3)).try_cast("double").alias("cost"))


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", quote="", escape="")


def write_text(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    df.select(column).write.mode(mode).text(path)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with reject_reason: the name of the first rule that doesn't hold (or is null), else null."""
    why = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        why = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(why)
    return df.withColumn("reject_reason", why)
