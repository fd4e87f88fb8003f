"""Scalar text functions on columns: normalisation, projection, quoting, classes, ligatures."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.errors import BadInput

#: Homographs and what replaces them, in the order that counts; patterns are Java regular expressions.
HOMOGRAPHS = (
    ("[_~#]", "~"), ('"', "''"), ("`", "'"), ("[“”]", "''"), ("´", "'"), ("[‘’]", "'"), ("„", ",,"), ("…", "..."), ("′", "'"),
    ("″", "''"), ("‴", "'''"), ("〃", "''"), ("µ", "μ"), ("[–—]", "-"), ("ﬂ", "fl"), ("ﬁ", "fi"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
)

PROJECTIONS = {"exact": None, "nospace": r"(?U)\s", "spletdig": "[^A-Za-z0-9 ]", "letdig": "[^A-Za-z0-9]", "letters": "[^A-Za-z]", "digits": "[^0-9]"}

#: What a language model sees: control signs out, quotes folded; with DIGITS also digits to 9 and the rest to "!".
LM_FOLDS = (
    (r"[\x00-\x1f]", ""), (r"(?U)\s+", " "), ("~", ""), ("`", "'"), ("´", "'"), ("‘", "'"), ("’", "'"), ("ſ", "s"), ("Ț", ","),
    ('"', "''"), ("“", "''"), ("”", "''"), ("„", ",,"), ("‟", "''"),
)
DIGITS = (("[0-9]", "9"), (r"""[^-=A-Za-z0-9.,?:()"/' ]""", "!"))

CONFUSABLE = ("cC", "l1I|/", "oO0", "sS", "uU", "vV", "wW", "xX", "zZ", ",'.`")

LIGATURES = ("ff", "fi", "fl", "ffi", "ffl", "st", "ft", "tt", "th", "ct")


def _apply(col: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], F.lit(r[1])), rules, col)


def _model_folds(col: Column) -> Column:
    """LM_FOLDS, of which no rule acts on what another gives: characters for characters at once, the rest by plain search."""
    col = F.regexp_replace(F.regexp_replace(col, r"[\x00-\x1f]+", ""), r"(?U)\s+", " ")
    return F.replace(F.replace(F.translate(col, "`´‘’ſȚ“”‟~", "''''s,\"\"\""), F.lit('"'), F.lit("''")), F.lit("„"), F.lit(",,"))


def _form(kind: str):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([x if x is None or x.isascii() or unicodedata.is_normalized(kind, x) else unicodedata.normalize(kind, x) for x in texts.to_pylist()], pa.string())

    return run


def nfc(col: Column) -> Column:
    """Canonical composition; Spark has no built-in for it, so text crosses to Arrow batches."""
    return _form("NFC")(col)


def nfkc(col: Column) -> Column:
    """Compatibility composition."""
    return _form("NFKC")(col)


#: White space of Java and the SQL; str.split takes four control signs more for it.
_SPACE, _NOT_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile("[\x1c-\x1f]")
_REPLACED = tuple((c, r) for p, r in HOMOGRAPHS for c in p.strip("[]") if c != r)
_DOTS, _FEW_DOTS = re.compile(r" *(?:\. *){4,}"), re.compile(r"\.(?: *\.){3}")
#: Bytes of UTF-8 that a projection drops: all of what isn't ASCII, and what its pattern has.
_DROPPED = {k: bytes(c for c in range(256) if c > 127 or re.match(p, chr(c))) for k, p in PROJECTIONS.items() if k not in ("exact", "nospace")}


def _normalized(x: str, compose: bool) -> str:
    if compose and not x.isascii() and not unicodedata.is_normalized("NFC", x):
        x = unicodedata.normalize("NFC", x)
    x = _SPACE.sub(" ", x).strip(" ") if _NOT_SPACE.search(x) else " ".join(x.split())
    for c, r in _REPLACED:
        x = x.replace(c, r)
    return x


def _projected(x: str, kinds: tuple[str, ...], compose: bool) -> list[str | bytes]:
    """One text on each of the alphabets."""
    x = _normalized(x, compose)
    if _FEW_DOTS.search(x):
        x = _DOTS.sub("....", x)
    x = x.replace("~", "").replace("_", "")
    data = x.encode()
    out: list[str | bytes] = []
    for kind in kinds:
        if kind == "lnc":  # what becomes A-Z one for one in upper case, so a sharp s doesn't turn into SS
            out.append(data.replace("ı".encode(), b"I").replace("ſ".encode(), b"S").translate(None, _DROPPED["letters"]).upper())
        elif kind == "exact":
            out.append(x)
        elif kind == "nospace":  # all white space is spaces by now
            out.append(x.replace(" ", ""))
        else:
            out.append(data.translate(None, _DROPPED[kind]))
    return out


def normalize_text(col: Column, compose: bool = True) -> Column:
    """NFC, white space runs to one space, ends trimmed, homographs replaced. compose=False for text known to be NFC."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _normalized(x, compose) for x in texts.to_pylist()], pa.string())

    return run(col)


def project_text(col: Column, kind: str = "exact", compose: bool = True) -> Column:
    """Text on the smaller alphabet in which two texts are compared."""
    return projections(col, (kind,), compose)[kind]


def projections(col: Column, kinds: tuple[str, ...], compose: bool = True) -> Column:
    """struct of a text's projections; several of one text should be asked for together.

    The text crosses to Python once, for NFC, and all that follows is done there: plain search and tables of bytes take a
    small part of the time of as many regular expressions.
    """
    for kind in kinds:
        if kind != "lnc" and kind not in PROJECTIONS:
            raise BadInput(f"no such projection: {kind}")

    @F.arrow_udf("struct<" + ", ".join(f"{k}: string" for k in kinds) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = [[None] * len(kinds) if x is None else _projected(x, kinds, compose) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(kinds))], list(kinds))

    return run(col)


def requote(col: Column) -> Column:
    """Two single quotes to the double quote."""
    return F.regexp_replace(col, "''", '"')


def requote_fancy(col: Column, germanic: bool = False) -> Column:
    """Typographic quotes by the white space beside straight ones; the white space goes with them."""
    left, right = ("”", "“") if germanic else ("“", "”")
    one_left, one_right = ("’", "‘") if germanic else ("‘", "’")
    return _apply(col, ((r"(?U)\s+''", left), (r"(?U)''\s+", right), (r"(?U)\s+,,", "„"), (r"(?U)\s+'", one_left), (r"(?U)'\s+", one_right), (r"(?U)\s+,", "‚")))


def fold_for_model(col: Column, digits: bool = False) -> Column:
    """The folding of text before character statistics."""
    return _apply(_model_folds(col), DIGITS) if digits else _model_folds(col)


_CONTROL = re.compile(LM_FOLDS[0][0] + "+")
_FOLDED, _DIGITS = LM_FOLDS[2:], tuple((re.compile(p), r) for p, r in DIGITS)


def folded(x: str, digits: bool = False) -> str:
    """fold_for_model of one text, in Python."""
    x = _SPACE.sub(" ", _CONTROL.sub("", x))
    for c, r in _FOLDED:
        x = x.replace(c, r)
    for p, r in _DIGITS if digits else ():
        x = p.sub(r, x)
    return x


def size_category(col: Column) -> Column:
    """x height, k ascender, y descender, "." or "'" of a single character, null otherwise."""
    classes = (("acemnorsuvwxyz", "x"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZbdfhklt!?", "k"), ("gpqy", "y"), (".,", "."), ("'\"`", "'"))
    out = F.lit(None).cast("string")
    for chars, name in reversed(classes):
        out = F.when(col.isin(*chars), name).otherwise(out)
    return out


def confusable_with(col: Column) -> Column:
    """The characters commonly taken for this one, itself included; null if there are none."""
    table = F.create_map(*[x for group in CONFUSABLE for c in group for x in (F.lit(c), F.array(*map(F.lit, group)))])
    return F.try_element_at(table, col)


def class_category(col: Column) -> Column:
    """What kind of class label a string is."""
    return (
        F.when(col.isNull() | (col == ""), "unlabeled").when(col == "~", "reject").when(F.length(col) > 1, "multi").when(col.rlike("^[A-Z]$"), "upper").when(col.rlike("^[a-z]$"), "lower")
        .when(col.rlike("^[0-9]$"), "digit").when(col.rlike(r"^[^\x00-\x7f]$"), "non-ascii").otherwise("other")
    )


def valid_class_label(col: Column) -> Column:
    """A class label has no white space or control sign, and isn't empty."""
    return F.coalesce(col.rlike(r"(?U)^[^\s\p{Cntrl}]+$"), F.lit(False))


def gt_explode(col: Column) -> Column:
    """Characters of a transcript in which _xx_ marks a ligature of up to four; "___" is an underscore."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"_(.{1,4})_|(?s:.)"), F.lit(0)), lambda x: F.when((F.length(x) >= 3) & x.startswith("_") & x.endswith("_"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def gt_implode(col: Column) -> Column:
    """The inverse of gt_explode; more than four characters in one give null."""
    return F.when(F.exists(col, lambda x: F.length(x) > 4), F.lit(None)).otherwise(F.array_join(F.transform(col, lambda x: F.when(x == "_", "___").when(F.length(x) <= 1, x).otherwise(F.concat(F.lit("_"), x, F.lit("_")))), ""))


def pack4(col: Column) -> Column:
    """Up to four characters of 16 bits each in one integer, the first in the low bits; null for more, or for a wider one."""
    out, fits = F.lit(0).cast("long"), F.length(col) <= 4
    for k in range(4):
        code = F.coalesce(F.ascii(F.substring(col, k + 1, 1)), F.lit(0)).cast("long")
        out, fits = out.bitwiseOR(F.shiftleft(code, 16 * k)), fits & (code < 65536)
    return F.when(fits, out)


def unpack4(col: Column) -> Column:
    """The inverse of pack4."""
    code = [F.shiftrightunsigned(col, 16 * k).bitwiseAND(65535) for k in range(4)]
    return F.concat(*[F.when(c > 0, F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")).when(c == 0, "") for c in code])


def escape_html(col: Column) -> Column:
    """& and < as entities."""
    return F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape_html(col: Column) -> Column:
    """The inverse of escape_html, and the other entities that editors write."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(c))
    return col


def font_folder(col: Column) -> Column:
    """A font file's name as a folder name: no path, no ending, only word characters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"^.*/", ""), r"\.[^.]*$", ""), r"[^0-9A-Za-z_]", "_")


def test_set(index: Column, sequence: int = 0, frac: int = 10) -> Column:
    """Whether an index belongs to the deterministic test split number `sequence` of `frac`."""
    return (F.abs(F.sin(index.cast("double"))) * 1.23456789e6).cast("long") % frac == sequence
