"""Codes of characters and ligatures, and the common sets of characters."""

from __future__ import annotations

import itertools
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII = string.digits + string.ascii_letters + string.punctuation
SETS = {
    "digits": string.digits, "letters": string.ascii_letters, "symbols": string.punctuation, "ascii": ASCII, "xsymbols": "©®°§¶†‡¡¿«»‹›÷¢£€•‣∙◦▪▫", "german": "ÄäÖöÜüß",
    "french": "ÀàÂâÆæÇçÉéÈèÊêËëÎîÏïÔôŒœÙùÛûÜüŸÿ", "portuguese": "ÁÃÌÍÒÓÕÚáãìíòóõú", "turkish": "ĞğŞşıſ", "greek": "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA), *range(0x3B1, 0x3CA)])),
}
SETS["default"] = "".join(dict.fromkeys(ASCII + SETS["xsymbols"] + SETS["german"] + SETS["french"] + SETS["portuguese"]))
SETS["european"] = "".join(dict.fromkeys(SETS["default"] + SETS["turkish"] + SETS["greek"]))

#: Ligatures get codes from here on, beyond every character's.
FIRST = 0x200000


def table() -> dict[str, int]:
    """Code of every single character and ligature, as models that use such codes have them; the order must never change."""
    codes = {"": 0, "<RHO>": 2, "<SIG>": 3, "<PHI>": 4, **{chr(i): i for i in range(32, 1024)}, "„": 0x201E, "“": 0x201C}
    pairs = string.ascii_uppercase + string.ascii_lowercase + string.digits + "'\"" + ".,:;?!"
    umlauts = "ÄÖÜäöüß"
    names = ["~~", "~~~", "~~~~", *map("".join, itertools.product(pairs, pairs)), *map("".join, itertools.product(("oo", "OO", "00", "ff", "mm"), pairs)), *map("".join, itertools.product(umlauts, pairs))]
    codes |= {name: FIRST + k for k, name in enumerate(names)}
    for k, c in enumerate(pairs, FIRST + len(names)):
        codes[c + "-"] = codes["-" + c] = k  # both orders share a code
    return codes


def code_of(name: str, codes: dict[str, int]) -> int:
    """A name's code; any single character has one, else -1."""
    return codes.get(name, ord(name) if len(name) == 1 else -1)


def table_frame(spark: SparkSession) -> DataFrame:
    """(name, code): the table as rows, some 6,000 whatever the data."""
    return spark.createDataFrame(sorted(table().items(), key=lambda x: x[1]), "name string, code long")


def set_members(spark: SparkSession) -> DataFrame:
    """(name, ch) of every character set."""
    return spark.createDataFrame([(n, c) for n, cs in SETS.items() for c in cs], "name string, ch string")


def ligatures_at(text, codes: list[str]):
    """Column: the two- and three-character ligatures that a text begins with."""
    return F.filter(F.array(F.substring(text, 1, 2), F.substring(text, 1, 3)), lambda x: (F.length(x) > 1) & x.isin(*codes))
