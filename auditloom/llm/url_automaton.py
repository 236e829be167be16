"""URL rules by one bit-parallel wildcard automaton.

Every rule becomes glob patterns over the canonical url, host (A-Z in lower case) followed by path. All patterns lie side
by side in one bit string, cut into 64-bit words: a pattern of n symbols has n + 1 bits, bit 0 its start. One byte of
the url moves all patterns at once (Shift-And, with self-loops for wildcards; the shift carries from word to word):

    state = ((state << 1) & advance[byte]) | (state & stay[byte])

A batch of urls is stepped together, byte by byte, the longest first, so a url costs nothing after its end. The last
few of very different lengths go on one by one, with the words as one whole number. Memory is one state a url, whatever its length.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one character but ``/``, a backslash takes the next character as it is.

Defined cases: a null url or one without ``://`` has empty host and path and is judged like any other; an empty path
doesn't start with ``/``, so it fits only rules without a path; userinfo and port belong to the host; of the rules
that fit the longest host and path together wins, then the longer host, then the earlier rule; repeated rows and null ids
stay as they are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts that are blocked where no rule fits; every other url is allowed.
BLOCKED_HOSTS = ("*spam*", "*pills*", "*casino*", "*porn*", "*warez*")
FEW = 24  #: urls that are left are stepped one by one

U = np.uint64


@dataclasses.dataclass(frozen=True)
class Symbol:
    """One position of a pattern: the bytes that enter it, and the bytes on which its state then stays."""

    enter: bytes
    stay: bytes


ANY = bytes(range(256))
WITHIN = bytes(b for b in ANY if b != 0x2F)
INNER = bytes(range(0x80, 0xC0))  # the further bytes of a character
FIRST = bytes(b for b in WITHIN if b not in INNER)


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def parse(glob: str) -> tuple[bytes, list[Symbol]]:
    """The bytes on which the start stays, and the symbols of a glob."""
    stays, symbols, at = [b""], [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            wide = glob.startswith("**", at)
            stays[-1] = ANY if wide or stays[-1] == ANY else WITHIN
            at += 2 if wide else 1
            continue
        if c == "?":
            symbols.append(FIRST)
            stays.append(INNER)
        else:
            if c == "\\" and at + 1 < len(glob):
                at += 1
            for b in glob[at].encode():
                symbols.append(bytes([b]))
                stays.append(b"")
        at += 1
    return stays[0], [Symbol(e, s) for e, s in zip(symbols, stays[1:], strict=True)]


class Automaton:
    """All globs of ``groups`` side by side; group k has a match where any of its globs has."""

    def __init__(self, groups: list[list[str]]):
        self.advance, self.stay, self.start, self.ends = [0] * 256, [0] * 256, 0, []
        at = 0
        for globs in groups:
            end = 0
            for g in globs:
                first, symbols = parse(g)
                self.start |= 1 << at
                for k, s in enumerate([Symbol(b"", first), *symbols]):
                    for b in s.enter:
                        self.advance[b] |= 1 << (at + k)
                    for b in s.stay:
                        self.stay[b] |= 1 << (at + k)
                at += len(symbols) + 1
                end |= 1 << (at - 1)
            self.ends.append(end)
        self.words = max(1, -(-at // 64))
        self.tables = self._words(self.advance), self._words(self.stay)

    def _words(self, numbers: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(n.to_bytes(8 * self.words, "little") for n in numbers), "<u8").reshape(len(numbers), self.words).astype(U)

    def run(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The states (urls x words) at the ends of the urls that ``off`` cuts ``data`` into."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        at, size = off[:-1][order], size[order]
        state = np.repeat(self._words([self.start]), len(order), axis=0)
        advance, stay = self.tables
        left, j = int((size > 0).sum()), 0
        while left > FEW:
            c, now = data[at[:left] + j], state[:left]
            moved = now << U(1)
            moved[:, 1:] |= now[:, :-1] >> U(63)
            state[:left] = (moved & advance[c]) | (now & stay[c])
            j += 1
            left = int(np.searchsorted(-size, -j, "left"))  # those longer than j
        for i in range(left):
            x = int.from_bytes(state[i].astype("<u8").tobytes(), "little")
            for b in data[at[i] + j : at[i] + size[i]].tobytes():
                x = ((x << 1) & self.advance[b]) | (x & self.stay[b])
                if not x:
                    break
            state[i] = self._words([x])[0]
        out = np.empty_like(state)
        out[order] = state
        return out

    def matches(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(urls x groups) booleans."""
        state, ends = self.run(data, off), self._words(self.ends)
        return np.stack([(state & e).any(axis=1) for e in ends], axis=1) if len(ends) else np.zeros((len(state), 0), bool)


def host_globs(host: str, path: str = "") -> list[str]:
    """Globs over the canonical url for a host glob, itself or as a parent domain, and a literal beginning of the path."""
    tails = [escape(path) + "**"] if path else ["", "/**"]
    return [h + t for h in (host, "*." + host) for t in tails]


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row: the longest rule that fits, else blocked hosts, else allow."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    names = [r[1] + r[2] for r in ranked] + [None, None]
    verdicts = [r[0] for r in ranked] + ["block", "allow"]
    groups = [host_globs(escape(host), path) for _, host, path in ranked] + [[g for h in blocked_hosts for g in host_globs(h)]]

    def decide(batches):
        machine = Automaton(groups)
        for b in batches:
            hit = machine.matches(*utf8(b.column(3)))
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(groups)) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()).take(pa.array(first)), pa.array(verdicts, pa.string()).take(pa.array(first))], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = canonical(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("canonical", F.concat("host", "path"))
    kind = p.schema["page_id"].dataType.simpleString()
    return p.mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string")
