"""URL filters: a bit-parallel wildcard automaton over canonical URLs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Verdict, host, path: a rule fits the host and its subdomains where the path starts with the rule's.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs that block where no host rule fits: ? is one character but /, * any but /, ** any.
BLOCK_GLOBS = tuple(h + p for h in ("ads-*", "*.ads-*", "ads.*", "*.ads.*", "*.doubleclick.*") for p in ("", "/**")) + ("**/ads/**", "**/adserver/**")
HOST = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"


@dataclass(frozen=True)
class Automaton:
    """All globs as one multiword Shift-And machine; a Python integer holds the words.

    Each glob has a bit for each character and one more for its end. A bit is set
    when the characters before it have been read. Reading c keeps the bits of stars
    that may swallow c and moves the bits that c matches on by one; a star's bit
    also sets the next bit at once.
    """

    moves: dict[str, int]  # by character: the bits that it matches
    other_moves: int  # for characters that no glob names
    stays: int  # stars that swallow /
    stays_but_slash: int
    skips: int  # bits of stars
    starts: int
    ends: tuple[tuple[int, int], ...]  # (end bit, number of the glob), by bit

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        parsed = [re.findall(r"\*\*|[\s\S]", g) for g in globs]
        names = {x for g in parsed for x in g if x not in ("*", "**", "?")}
        moves, other, stays, narrow, skips, starts, ends, bit = dict.fromkeys(names, 0), 0, 0, 0, 0, 0, [], 0
        for k, glob in enumerate(parsed):
            starts |= 1 << bit
            for x in glob:
                if x in ("*", "**"):
                    skips |= 1 << bit
                    stays, narrow = stays | (x == "**") << bit, narrow | 1 << bit
                elif x == "?":
                    other |= 1 << bit
                else:
                    moves[x] |= 1 << bit
                bit += 1
            ends.append((bit, k))
            bit += 1
        return cls({x: m | (other if x != "/" else 0) for x, m in (moves | {"/": moves.get("/", 0)}).items()}, other, stays, narrow, skips, starts, tuple(ends))

    def close(self, state: int) -> int:
        while (more := state | (state & self.skips) << 1) != state:
            state = more
        return state

    def matches(self, text: str) -> list[int]:
        """The numbers of the globs that match the whole text."""
        state, moves, other = self.close(self.starts), self.moves, self.other_moves
        for c in text:
            if not state:
                break
            state = self.close(state & (self.stays if c == "/" else self.stays_but_slash) | (state & moves.get(c, other)) << 1)
        return [k for bit, k in self.ends if state >> bit & 1]


def judge(host: str, path: str, machine: Automaton, rules: list[tuple[str, str, str]], n_host_globs: int) -> tuple[str | None, str]:
    """The longest rule that fits, and the verdict: the rule's, else block where a glob matches, else allow."""
    found = machine.matches(host + path)
    fitting = [rules[k // 2] for k in found if k < n_host_globs]
    if fitting:
        verdict, h, p = max(fitting, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block", r[1:]))
        return h + p, verdict
    return None, "block" if found else "allow"


def filtered(pages: DataFrame, rules: tuple = HOST_RULES, globs: tuple[str, ...] = BLOCK_GLOBS, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row a page: ``keep``, host, path, rule, verdict.

    The canonical URL is the host, with A to Z in lower case, and the path, without
    query and fragment. A null URL, or one without ``://``, has an empty host and
    path; no rule fits it and it is allowed. Equal URLs get equal verdicts; an empty
    table gives none. One pass without a shuffle; the machine grows with the rules only.
    """
    host_globs = [g for _, h, p in rules for g in (f"{h}{p}**", f"*.{h}{p}**")]
    rules, machine, n = list(rules), Automaton.of([*host_globs, *globs]), len(host_globs)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    address = F.coalesce(F.col(url), F.lit(""))
    parts = pages.select(*[F.col(c).alias(c) for c in keep], F.translate(F.regexp_extract(address, HOST, 1), upper, lower).alias("host"), F.regexp_extract(address, PATH, 1).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(h, p, machine, rules, n) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], [*b.schema.names, "rule", "verdict"])

    schema = StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return parts.mapInArrow(run, schema)
