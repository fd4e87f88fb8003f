"""Personal data by a skip-chain conditional random field.

Tokens are runs of non-space. Nodes are those that hold a digit, "@" or "=", those that a secret cue announces ("password:
x", "token = x", "key is x"), and every other mention in the document of a token so announced; all other tokens can have no
label but "none" by a tag dictionary, so they only serve as context and the field is exact without them. (Names and street
addresses aren't among the labels.) Neighbouring nodes share chain potentials. All mentions of one token in a document
share a hub, a node that stands for what they have in common, and so do all tokens that are similar (same mail domain, network or
leading digits); the potentials between a mention and its hubs carry what one mention shows to all others, at the same
distance whatever their number. Loopy belief propagation (sum-product) runs over all documents of a batch at once until no
message changes by more than SETTLED; loops may keep messages from settling, after ROUNDS rounds they are taken as they
are. Every node takes its most probable label; ties go to the first of LABELS.

The weights are trained on the driver, by gradient ascent on the approximate likelihood, from SENTENCES generated
examples, in which things are mentioned again without what gave them away; the same seed gives the same weights.

Null doc_id or text: no result. Empty text: no row. Texts are scanned whole; a very long one is a batch of its own, whose
task holds its tokens' places, about 5 bytes a byte. Repeated rows give repeated results. A document without an entity has
no row. Other columns, whatever their names, are ignored. No rows: an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import shared, textkernel

LABELS = ("none", "email", "phone", "ip", "card", "secret")
ROUNDS, SETTLED, SENTENCES, STEPS, SEED = 2000, 1e-4, 500, 110, 5
SPECIAL = np.zeros(256, np.uint8)
SPECIAL[[ord(c) for c in "0123456789@="]] = 1
SOLID = np.ones(256, np.uint8)
SOLID[[9, 10, 11, 12, 13, 32]] = 0

_CORE = re.compile(r"^[^\w+(]*(.*?)[^\w)]*$", re.S)
_EMAIL = re.compile(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+")
_IP = re.compile(r"\d{1,3}(\.\d{1,3}){3}")
_PHONE = re.compile(r"(\+?\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}")
_CUES = {
    "phone": {"call", "phone", "tel", "telephone", "mobile", "fax", "cell", "dial"},
    "secret": {"token", "key", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "bearer", "pwd"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "ip": {"ip", "host", "server", "address", "ping"},
    "version": {"version", "release", "build", "v"},
    "number": {"order", "invoice", "page", "chapter", "section", "year", "no", "nr", "id", "license", "isbn", "by-nc", "by", "cc"},
}
FEATURES: dict[str, int] = {}
_NAMES = (
    "bias email at ip version luhn cardlike d1 d5 d10 d13 d17 plus area local phone hex mixed upper quoted equals assigned date time money percent word mail_part other"
    " prev_phone prev_secret prev_card prev_ip prev_number prev_equals prev_plus prev_area next_equals next_area next_local next_word"
    " plain announced run_card run_phone run_other prev_version tied hub formatted"
).split()
FEATURES.update({n: i for i, n in enumerate(_NAMES)})


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def core(token: str) -> str:
    """The token without the punctuation around it; a lone "=" stays."""
    m = _CORE.match(token)
    return m[1] if m and m[1] else token if "=" in token else ""


def shape(token: str) -> list[str]:
    """Features of one token by itself."""
    c = core(token)
    digits = re.sub(r"[ \-]", "", c)
    out = ["bias"]
    if c.strip("=") == "":
        return [*out, "equals"]
    if "=" in c:
        out.append("assigned")
        c = c.rpartition("=")[2].strip("\"'") or c
    if any(q in token for q in "\"'"):
        out.append("quoted")
    if _EMAIL.fullmatch(c):
        return [*out, "email"]
    if "@" in c:
        return [*out, "at"]
    if _IP.fullmatch(c):
        return [*out, "ip" if all(int(x) < 256 for x in c.split(".")) else "version"]
    if re.fullmatch(r"v?\d+(\.\d+)+", c):
        return [*out, "version"]
    if re.fullmatch(r"\+\d{1,3}", c):
        return [*out, "plus"]
    if re.fullmatch(r"\(\d{3}\)", c):
        return [*out, "area"]
    if re.fullmatch(r"\d{3}-\d{4}", c):
        return [*out, "local"]
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d?[/.]\d\d?[/.]\d{2,4}", c):
        return [*out, "date"]
    if re.fullmatch(r"\d\d?:\d\d(:\d\d)?", c):
        return [*out, "time"]
    if re.search(r"[$€£]", token[:1]):
        return [*out, "money"]
    if token.endswith("%") and not token.endswith("%%"):
        return [*out, "percent"]
    if digits.isdigit():
        n = len(digits)
        if 13 <= n <= 19 and digits[0] in "3456" and luhn(digits):
            return [*out, "luhn", "cardlike"]
        if 13 <= n <= 19 and luhn(digits):
            return [*out, "luhn", "d13"]
        kind = "d1" if n < 5 else "d5" if n < 10 else "d10" if n < 13 else "d13" if n < 20 else "d17"
        return [*out, kind, *(["phone"] if n in (10, 11) else []), *(["formatted"] if c != digits and _PHONE.fullmatch(c) else [])]
    if _PHONE.fullmatch(c):
        return [*out, "phone"]
    alnum = re.sub(r"[^0-9A-Za-z]", "", c)
    if len(alnum) >= 16 and re.search(r"\d", alnum) and re.search(r"[A-Za-z]", alnum):
        return [*out, "hex" if re.fullmatch(r"[0-9a-fA-F]+", alnum) else "upper" if alnum.isupper() else "mixed"]
    return [*out, "word" if re.search(r"[^\W\d]", c) else "other", *([] if any(x.isdigit() for x in c) else ["plain"])]


def _cue(word: str) -> str | None:
    w = word.strip(".,:;!?()\"'=").lower()
    return next((k for k, ws in _CUES.items() if w in ws), None)


def announced(before: str, second: str) -> bool:
    """Whether the tokens before one, the nearest first, announce a secret: "password:", "token =", "key is"."""
    if before.rstrip("\"'")[-1:] in (":", "=") and before.strip(":=\"'"):
        return _cue(before) == "secret"
    return before in (":", "=", ":=", "is", "was") and _cue(second) == "secret"


def context(before: str, after: str, second: str = "") -> list[str]:
    """Features of the tokens beside one; second is the one before before."""
    out = []
    if cue := _cue(before):
        out.append(f"prev_{cue}")
    if announced(before, second):
        out.append("announced")
    if "=" in before:
        out.append("prev_equals")
    b, a = core(before), core(after)
    if re.fullmatch(r"\+\d{1,3}", b):
        out.append("prev_plus")
    if re.fullmatch(r"\(\d{3}\)", b):
        out.append("prev_area")
    if after[:1] == "=":
        out.append("next_equals")
    if re.fullmatch(r"\(\d{3}\)", a):
        out.append("next_area")
    if re.fullmatch(r"\d{3}-\d{4}", a):
        out.append("next_local")
    if a.isalpha():
        out.append("next_word")
    return out


def run_features(cores: list[str]) -> list[str]:
    """Features that all tokens of a run of numbers have, as of a card or phone number written in groups."""
    if len(cores) < 2:
        return []
    size, digits = [len(c) for c in cores], "".join(cores)
    if len(cores) >= 3 and 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits):
        return ["run_card"]
    return ["run_phone"] if size[-3:] == [3, 3, 4] and len(size) <= 4 and sum(size[:-3]) <= 3 else ["run_other"]


def kin(token: str) -> str | None:
    """What a similar token shares with this one; None if nothing tells."""
    c = core(token).lower()
    if "@" in c:
        return "@" + c.rpartition("@")[2]
    if _IP.fullmatch(c):
        return c.rpartition(".")[0] + "."
    digits = re.sub(r"\D", "", c)
    return digits[:8] if len(digits) >= 10 else None


class Graph:
    """Nodes, hubs and edges of many documents. kind of an edge: 0 chain, 1 mention of a token, 2 of a similar token."""

    def __init__(self):
        self.features: list[tuple[int, int]] = []
        self.nodes = self.hubs = 0
        self.edges: list[tuple[int, int, int]] = []  # a hub is numbered -1, -2, ... until arrays
        self.members: list[list[int]] = []

    def add(self, tokens: list[tuple[int, str, str, str, str]]) -> None:
        """One document's nodes in order: (index of the token, token, token before, token after, the one before that before)."""
        same: dict[str, list[int]] = {}
        alike: dict[str, list[tuple[int, str]]] = {}
        cores = [core(t[1]) for t in tokens]
        k = 0
        while k < len(tokens):  # runs of numbers side by side
            stop = k + 1
            if cores[k].isdigit():
                while stop < len(tokens) and tokens[stop][0] == tokens[stop - 1][0] + 1 and cores[stop].isdigit():
                    stop += 1
                names = run_features(cores[k:stop])
                self.features += [(self.nodes + j, FEATURES[f]) for j in range(k, stop) for f in names]
            k = stop
        for k, (index, token, before, after, second) in enumerate(tokens):
            node = self.nodes + k
            self.features += [(node, FEATURES[f]) for f in (*shape(token), *context(before, after, second))]
            if k and tokens[k - 1][0] == index - 1:
                self.edges.append((node - 1, node, 0))
            name, near = cores[k].lower(), kin(token)
            if len(name) > 4:
                same.setdefault(name, []).append(node)
                if near:
                    alike.setdefault(near, []).append((node, name))
        self.nodes += len(tokens)
        for nodes in same.values():
            self._hub(nodes, 1)
        for found in alike.values():
            if len({name for _, name in found}) > 1:
                self._hub([node for node, _ in found], 2)

    def _hub(self, nodes: list[int], kind: int) -> None:
        if len(nodes) > 1:
            self.hubs += 1
            self.members.append(nodes)
            self.edges += [(n, -self.hubs, kind) for n in nodes]
            self.features += [(n, FEATURES["tied"]) for n in nodes if kind == 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(features, edges), the hubs numbered after all nodes."""
        edges = np.array(self.edges, np.int64).reshape(-1, 3)
        edges[:, 1] = np.where(edges[:, 1] < 0, self.nodes - 1 - edges[:, 1], edges[:, 1])
        hubs = np.stack([np.arange(self.nodes, self.nodes + self.hubs), np.full(self.hubs, FEATURES["hub"])], 1)
        return np.concatenate([np.array(self.features, np.int64).reshape(-1, 2), hubs]), edges


def chosen(tokens: list[str]) -> list[tuple[int, str, str, str, str]]:
    """The nodes of one document, given all its tokens, as Graph.add takes them."""
    at = lambda k: tokens[k] if 0 <= k < len(tokens) else ""
    told = [k for k, t in enumerate(tokens) if any(c in "0123456789@=" for c in t) or (announced(at(k - 1), at(k - 2)) and core(t))]
    names = {core(tokens[k]).lower() for k in told if not any(c in "0123456789@=" for c in tokens[k]) and len(core(tokens[k])) > 4}
    again = [k for k, t in enumerate(tokens) if core(t).lower() in names] if names else []
    return [(k, tokens[k], at(k - 1), at(k + 1), at(k - 2)) for k in sorted({*told, *again})]


def _norm(x: np.ndarray) -> np.ndarray:
    m = x.max(-1, keepdims=True)
    return x - m - np.log(np.exp(x - m).sum(-1, keepdims=True))


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes and edges by sum-product message passing in log space, damped by half, until all messages settle."""
    n, e = len(unary), len(edges)
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    table = pair[edges[:, 2]]
    table = np.concatenate((table, table.transpose(0, 2, 1)))  # [edge, label of src, label of dst]
    message = np.full((2 * e, unary.shape[1]), -np.log(unary.shape[1]))
    back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))

    def total() -> np.ndarray:
        out = unary.copy()
        np.add.at(out, dst, message)
        return out

    live, at = np.arange(2 * e), total()
    for _ in range(rounds):
        if not len(live):
            break
        x = (at[src[live]] - message[back[live]])[:, :, None] + table[live]
        m = x.max(1)
        fresh = _norm(m + np.log(np.exp(x - m[:, None, :]).sum(1)))
        change = _norm(np.logaddexp(fresh, message[live])) - message[live]
        message[live] += change
        np.add.at(at, dst[live], change)
        far = np.abs(fresh - message[live]).max(1) > SETTLED  # from where it goes: a damped step may be small
        moved, again = np.zeros(n, bool), np.zeros(2 * e, bool)
        moved[dst[live[np.abs(change).max(1) > SETTLED]]] = again[live[far]] = True
        live = np.flatnonzero(again | moved[src])
    node = _norm(total())
    both = (total()[src] - message[back])[:e, :, None] + (total()[dst] - message)[:e, None, :] + table[:e]
    return np.exp(node), np.exp(_norm(both.reshape(e, -1))).reshape(both.shape) if e else np.zeros((0, unary.shape[1], unary.shape[1]))


def _unary(features: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((n, weight.shape[1]))
    np.add.at(out, features[:, 0], weight[features[:, 1]])
    return out


def examples(count: int = SENTENCES, seed: int = SEED) -> Iterator[list[tuple[str, str]]]:
    """Generated documents as (token, label) lists: words, entities of every kind, and what looks like them."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "on", "the", "ti", "sh", "ou", "é", "ch", "en")) for _ in range(rng.randint(1, 4)))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            c = rng.choice("3456" if valid else "123456789") + digits(15)
            if luhn(c) == valid:
                return c

    def email() -> str:
        return f"{word()}{rng.choice(('.', '_', '')) + digits(rng.randint(0, 3))}@{word()}{rng.choice(('', digits(1)))}.{rng.choice(('com', 'example.com', 'org', 'co.uk'))}"

    def phone() -> list[tuple[str, str]]:
        a, b = digits(3), f"{digits(3)}-{digits(4)}"
        cue = (rng.choice(("call", "phone", "tel")), "")
        return rng.choice((
            [(f"+{digits(rng.randint(1, 2))}", "phone"), (f"({a})", "phone"), (b, "phone")], [(f"({a})", "phone"), (b, "phone")], [(f"{a}-{b}", "phone")], [cue, (a + digits(7), "phone")], [cue, (a + digits(7), "phone")],
            [cue, (a, "phone"), (digits(3), "phone"), (digits(4), "phone")], [("+1", "phone"), (a, "phone"), (digits(3), "phone"), (digits(4), "phone")],
        ))

    def secret() -> list[tuple[str, str]]:
        value = rng.choice((hexed(rng.choice((32, 40))), "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), "sk" + "".join(rng.choice("abcdefghXYZ0123456789") for _ in range(28))))
        name = rng.choice(sorted(_CUES["secret"]))
        said = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(7, 24)))
        said = rng.choice((said, said[:4] + "-" + said[4:], said.capitalize()))
        return rng.choice((
            [(name, ""), ("=", "none"), (f'"{value}"', "secret")], [(f"{name}={value}", "secret")], [(name, ""), ("=", "none"), (value, "secret")], [(name + ":", ""), (value, "secret")],
            [(name + ":", ""), (said, "secret")], [(name, ""), ("=", "none"), (said, "secret")], [(name, ""), ("is", ""), (said, "secret")],
        ))

    def decoy() -> list[tuple[str, str]]:
        return rng.choice((
            [("version", ""), (f"{digits(1)}.{digits(1)}.", "none")], [(f"{rng.randint(256, 999)}.{digits(2)}.{digits(3)}.{rng.randint(256, 999)}", "none")], [(f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", "none")],
            [(f"1{digits(1)}:{rng.randint(10, 59)}", "none")], [(f"${digits(2)}.{digits(2)}", "none")], [(f"{digits(2)}%", "none")], [(card(False), "none")], [("order", ""), (digits(rng.randint(5, 12)), "none")], [(digits(rng.randint(1, 9)), "none")],
            [(digits(10), "none")], [(digits(10), "none")], [("version", ""), (".".join(str(rng.randint(0, 40)) for _ in range(4)), "none")], [(digits(rng.choice((2, 3, 4))), "none") for _ in range(rng.randint(2, 4))],
            [(f"{word()}{digits(2)}", "none")], [("x", ""), ("=", "none"), (digits(2), "none")], [(f"{word()}@{word()}", "none")], [("commit", ""), (hexed(7), "none")], [(digits(24), "none")], [(f"n={digits(2)}", "none")], [(f"{digits(3)}-{digits(3)}", "none")],
        ))

    def similar(entity: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Another of the same kind that shares its domain, network or leading digits."""
        t, label = entity[-1]
        if label == "email":
            return [(f"{word()}@{t.rpartition('@')[2]}", label)]
        if label == "ip":
            return [(f"{t.rpartition('.')[0]}.{rng.randint(0, 255)}", label)]
        return [(t[:8] + digits(2), label)] if label == "phone" and re.fullmatch(r"\d{10}", t) else []

    for _ in range(count):
        doc: list[tuple[str, str]] = []
        kept: list[list[tuple[str, str]]] = []
        for _ in range(rng.randint(1, 6)):
            doc += [(word(), "") for _ in range(rng.randint(1, 4))]
            pick = rng.random()
            if kept and pick < 0.35:  # a mention again, or a similar one, without what was around it
                old = [x for x in rng.choice(kept) if x[1]]
                old = [x for x in old if x[1] != "none"] or old
                if pick < 0.08 and (other := similar(old) if old else []):
                    doc += other
                    continue
                for _ in range(rng.choice((1,) * 9 + (2, 3, 8, 20, 60) if len(old) == 1 else (1,))):
                    doc += [*old, (word(), "")]
                continue
            ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            number = card(True)
            grouped = [(number[k : k + 4], "card") for k in range(0, 16, 4)]
            new = rng.choice(([(email(), "email")], phone(), [(ip, "ip")], rng.choice(([(number, "card")], grouped)), secret())) if pick < 0.7 else decoy()
            kept.append(new)
            end = rng.choice(("", "", "", ".", ",", "%%%", "!!", "$$$"))
            doc += [*new[:-1], (new[-1][0] + end if not new[-1][0].endswith(("%", ".")) else new[-1][0], new[-1][1])]
        yield doc + [(word(), "")]


def labelled(docs: Iterator[list[tuple[str, str]]]) -> tuple[Graph, np.ndarray]:
    """(graph, labels of its nodes and hubs) of (token, label) lists; a hub has the label of most mentions that have one."""
    graph, gold = Graph(), []
    for doc in docs:
        nodes = chosen([t for t, _ in doc])
        graph.add(nodes)
        gold += [LABELS.index(doc[k][1] or "none") for k, *_ in nodes]
    for members in graph.members:
        own = [gold[k] for k in members if gold[k]]
        gold.append(max(set(own), key=own.count) if own else 0)
    return graph, np.array(gold)


@cache
def train(count: int = SENTENCES, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, pair weights by kind of edge)."""
    graph, gold = labelled(examples(count, seed))
    features, edges = graph.arrays()
    k = len(LABELS)
    one = np.eye(k)[gold]
    seen_pair = one[edges[:, 0]][:, :, None] * one[edges[:, 1]][:, None, :]
    weight, pair = np.zeros((len(FEATURES), k)), np.zeros((3, k, k))
    gw, gp = np.full_like(weight, 1e-3), np.full_like(pair, 1e-3)
    for _ in range(steps):
        node, both = beliefs(_unary(features, len(gold), weight), edges, pair, 4)
        dw, dp = -0.05 * weight, -0.05 * pair
        np.add.at(dw, features[:, 1], (one - node)[features[:, 0]])
        np.add.at(dp, edges[:, 2], seen_pair - both)
        gw, gp = gw + dw**2, gp + dp**2
        weight, pair = weight + 0.7 * dw / np.sqrt(gw), pair + 0.7 * dp / np.sqrt(gp)
    return weight, pair


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token index, token starts, token ends): indices into the tokens of those that are nodes."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    solid = SOLID[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= solid[:-1] ^ 1
    end[:-1] &= solid[1:] ^ 1
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge], end[edge - 1] = solid[edge], solid[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    special = np.flatnonzero(SPECIAL[data])
    token = np.unique(np.searchsorted(s, special, side="right") - 1)
    told = _announced_tokens(data.tobytes(), off, s, e)
    if len(told):
        token = np.unique(np.concatenate((token, told)))
    return np.searchsorted(off, s[token], side="right") - 1, token, s, e


_SAYS = re.compile(rb"(?i)(?<![^\s\"'(])(?:%s)[\"']?(?:\s*(?::=|[:=])|\s+(?:is|was)(?=\s))" % b"|".join(sorted((w.encode() for w in _CUES["secret"]), key=len, reverse=True)))


def _announced_tokens(raw: bytes, off: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Tokens without a digit, "@" or "=" that a secret cue announces, and their other mentions in the same text."""
    out: list[int] = []
    piece = lambda t: raw[s[t] : e[t]].decode("utf-8", "replace")
    for m in _SAYS.finditer(raw):
        t = int(np.searchsorted(s, m.end()))  # the token after the cue and its sign
        if t >= len(s) or t < 1:
            continue
        row = int(np.searchsorted(off, m.start(), side="right")) - 1
        first, last = int(np.searchsorted(s, off[row])), int(np.searchsorted(s, off[row + 1]))
        if t >= last or not announced(piece(t - 1), piece(t - 2) if t - 2 >= first else "") or not core(piece(t)):
            continue
        out.append(t)
        name = core(piece(t)).lower()
        if len(name) > 4:
            out += [k for x in re.finditer(re.escape(core(piece(t)).encode()), raw[off[row] : off[row + 1]], re.I) for k in [int(np.searchsorted(s, off[row] + x.start(), side="right")) - 1] if k >= first and core(piece(k)).lower() == name]
    return np.array(out, np.int64)


def tag(column: pa.Array, weight: np.ndarray, pair: np.ndarray) -> Iterator[tuple[int, str, int, int, str]]:
    """(row, label, first character, end character, text) of the entities of a column of texts."""
    data, off = textkernel.utf8(column, lower=False)
    for i, j in textkernel.slices(off, 4 << 20):
        own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        row, token, s, e = candidates(own, at)
        if not len(token):
            continue
        raw = own.tobytes()
        piece = lambda t: raw[s[t] : e[t]].decode("utf-8", "replace")
        graph, cuts = Graph(), np.flatnonzero(np.diff(row)) + 1
        for k in np.split(np.arange(len(token)), cuts):
            lo, hi = int(np.searchsorted(s, at[row[k[0]]])), int(np.searchsorted(s, at[row[k[0]] + 1]))
            near = lambda t: piece(t) if lo <= t < hi else ""  # noqa: B023, E731
            graph.add([(t, piece(t), near(t - 1), near(t + 1), near(t - 2)) for t in token[k].tolist()])
        features, edges = graph.arrays()
        label = beliefs(_unary(features, graph.nodes + graph.hubs, weight), edges, pair)[0].argmax(1)
        lead = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        k = 0
        while k < len(token):
            if not label[k]:
                k += 1
                continue
            stop = k + 1
            while stop < len(token) and label[stop] == label[k] and (LABELS[label[k]] == "phone" or (LABELS[label[k]] == "card" and len(core(piece(token[k]))) < 7 > len(core(piece(token[stop]))))) and token[stop] == token[stop - 1] + 1 and row[stop] == row[k]:
                stop += 1
            first, last = piece(token[k]), piece(token[stop - 1])
            a = s[token[k]] + len(first[: first.find(core(first)[:1])].encode()) if core(first) else s[token[k]]
            inner = core(last)
            b = s[token[stop - 1]] + len(last[: last.find(inner) + len(inner)].encode()) if inner else e[token[stop - 1]]
            begin = lead[at[row[k]]]
            yield i + int(row[k]), LABELS[label[k]], int(lead[a] - begin), int(lead[b] - begin), raw[a:b].decode("utf-8", "replace")
            k = stop


def entities(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, label, start, end, value): every entity, start and end counting the characters of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(tag(batch.column("text"), *sent.value))
            ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.string())))], ["doc_id", "label", "start", "end", "value"])

    docs = shared.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return docs.mapInArrow(shared.lean(run), "doc_id long, label string, start long, end long, value string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
