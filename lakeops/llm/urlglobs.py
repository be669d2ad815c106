"""URL filter rules as one bit-parallel automaton.

Every rule is a glob over the canonical form ``.host/path`` of a URL (A-Z of the host in lower
case, no scheme, query or fragment).  In a glob ``*`` stands for any run of characters but ``/``,
``**`` for any run, ``?`` for any one byte but ``/``, and all else for itself.  All globs are
packed into one row of 64-bit words with a bit per position; the whole set advances by one
shift, two masks and an or per character, over all URLs of a batch at once (Shift-And with
self-loops for the wildcards).  Of the rules whose last bit is set after the last character,
the longest decides; equal lengths go by the order given.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict; so do URLs that no rule fits.  URLs of any length are read whole.  An empty table
gives no rows, an empty rule list only defaults.  Rows are judged one by one, so repeated rows
and ids are kept as they are; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import map_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of state held at a time while a batch is advanced.
STATE_BYTES = 8_000_000


@dataclass(frozen=True)
class Rule:
    """A glob with its verdict; ``name`` is what is reported."""

    name: str
    glob: str
    verdict: str
    weight: int


def domain_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and its subdomains, and paths that start with the rule's."""
    host, slash, path = name.partition("/")
    if not slash:
        raise ValueError("a domain rule is host/path, with the slash")
    return Rule(name, f"*.{host}/{path}**", verdict, len(name))


class Automaton:
    """Shift-And masks of all globs, and the states after a batch of byte strings."""

    def __init__(self, globs: Sequence[str]):
        steps: list[tuple[str, bool]] = []  # per position: what it accepts, and whether it is a start
        loops: dict[int, str] = {}
        self.last = []
        for glob in globs:
            steps.append(("", True))
            at = 0
            raw = glob.encode()
            while at < len(raw):
                if raw[at : at + 2] == b"**":
                    loops[len(steps) - 1] = "any"
                    at += 2
                elif raw[at : at + 1] == b"*":
                    loops.setdefault(len(steps) - 1, "part")
                    at += 1
                else:
                    steps.append(("?" if raw[at : at + 1] == b"?" else chr(raw[at]), False))
                    at += 1
            self.last.append(len(steps) - 1)
        words = -(-max(len(steps), 1) // 64)
        self.start = np.zeros(words, np.uint64)
        self.step = np.zeros((257, words), np.uint64)
        self.stay = np.zeros((257, words), np.uint64)
        for i, (accepts, starts) in enumerate(steps):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if starts:
                self.start[word] |= bit
            elif accepts == "?":
                self.step[:256, word] |= bit
                self.step[ord("/"), word] &= ~bit
            else:
                self.step[ord(accepts), word] |= bit
            if i in loops:
                self.stay[:256, word] |= bit
                if loops[i] == "part":
                    self.stay[ord("/"), word] &= ~bit
        self.stay[256] = ~np.uint64(0)  # beyond the end of a shorter string nothing moves

    def states(self, texts: list[bytes]) -> np.ndarray:
        """State words after each text, texts of like length together."""
        out = np.zeros((len(texts), len(self.start)), np.uint64)
        order = np.argsort([len(t) for t in texts], kind="stable")
        for some in np.array_split(order, max(1, -(-len(texts) // 64))):
            longest = max((len(texts[i]) for i in some), default=0)
            now = np.tile(self.start, (len(some), 1))
            block = max(1, STATE_BYTES // (2 * max(1, len(some))))
            for at in range(0, longest, block):
                width = min(block, longest - at)
                chars = np.full((len(some), width), 256, np.uint16)
                for row, i in enumerate(some):
                    if len(texts[i]) > at:
                        count = min(width, len(texts[i]) - at)
                        chars[row, :count] = np.frombuffer(texts[i], np.uint8, count, at)
                for k in range(width):
                    c = chars[:, k]
                    moved = now << np.uint64(1)
                    moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                    now = (moved & self.step[c]) | (now & self.stay[c])
            out[some] = now
        return out

    def hits(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text (row) is matched by each glob (column)."""
        last = np.array(self.last, np.int64)
        return (self.states(texts)[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1) > 0


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row."""
    ranked = sorted(rules, key=lambda r: -r.weight)
    names, verdicts = [r.name for r in ranked], [r.verdict for r in ranked]
    globs = [r.glob for r in ranked]
    parts = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    cut = pages.select(
        F.col(key).alias("key"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")).alias("path"),
    )

    def build():
        automaton = Automaton(globs)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            if globs:
                hits = automaton.hits([("." + h + p).encode() if h or p else b"" for h, p in zip(hosts, paths)])
                first = np.where(hits.any(axis=1), hits.argmax(axis=1), -1).tolist()
            else:
                first = [-1] * len(hosts)
            rule = [names[i] if i >= 0 else None for i in first]
            verdict = [verdicts[i] if i >= 0 else default for i in first]
            columns = [batch["key"], batch["host"], batch["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "host", "path", "rule", "verdict"])

        return run

    kind = pages.schema[key].dataType.simpleString()
    found = map_batches(cut, build, f"key {kind}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("key", key)
