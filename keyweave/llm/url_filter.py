"""URL rules as one bit-parallel automaton.

Every rule is a glob over the canonical URL "." + host + path. All globs lie side by side in
multiword Shift-And masks; one pass over the bytes of a URL moves the states of all rules, and
numpy moves those of a block of URLs at once. No shuffle: a hot host is nothing special.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm._common import ascii_lower


class Rule(NamedTuple):
    verdict: str
    rule: str  # host with path, such as "example.net/en/"


class Globs:
    """Globs over bytes: * is any run without '/', ** any run; all else stands for itself.

    Each glob has a bit for "j literals matched", j from 0; a wildcard is a loop on its bit.
    """

    def __init__(self, globs: Sequence[str]):
        step: list[tuple[int, int]] = []  # byte that leads to a bit
        loops: list[tuple[int, bool]] = []  # bit, whether '/' may loop too
        self.starts, self.ends, bit = [], [], 0
        for glob in globs:
            self.starts.append(bit)
            rest = glob.encode()
            while rest:
                if rest.startswith(b"*"):
                    wide = rest.startswith(b"**")
                    loops.append((bit, wide))
                    rest = rest[2 if wide else 1 :]
                else:
                    bit += 1
                    step.append((rest[0], bit))
                    rest = rest[1:]
            self.ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.moves = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        for byte, at in step:
            self.moves[byte, at // 64] |= np.uint64(1 << at % 64)
        for at, wide in loops:
            stays = np.full(256, 1 << at % 64, np.uint64)
            stays[ord("/")] *= np.uint64(wide)
            self.stays[:, at // 64] |= stays
        self.first = np.zeros(self.words, np.uint64)
        for at in self.starts:
            self.first[at // 64] |= np.uint64(1 << at % 64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row per text and a column per glob: whether the glob fits the whole text."""
        block = max(1, (1 << 22) // self.words)
        return np.concatenate([self._match(texts[i : i + block]) for i in range(0, len(texts), block)] or [np.zeros((0, len(self.ends)), bool)])

    def _match(self, texts: Sequence[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")  # the texts still running are a prefix
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.tile(self.first, (len(texts), 1))
        for i in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -i))  # those longer than i
            byte = data[at[:n] + i]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.moves[byte]) | (now & self.stays[byte])
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return out


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    """The order in which fitting rules win: longest first, of equal length block before allow, then by text."""
    return sorted({Rule(*r) for r in rules}, key=lambda r: (-len(r.rule), r.verdict != "block", r.rule))


@lru_cache(maxsize=8)
def _compiled(rules: tuple[str, ...]) -> Globs:
    return Globs([f"*.{r}**" for r in rules])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ://."""
    found = F.locate("://", url) > 0
    after = F.regexp_extract(url, r"(?s)://(.*)", 1)
    rest = F.regexp_extract(after, r"^([^?#]*)", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/]*(/.*)$", 1)
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def judge_urls(df: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of df: key, host, path, rule, verdict.

    Host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased, port and user
    name included; path: from there up to ?, # or the end. A rule fits its host and all
    subdomains if the path starts with the rule's. The longest fitting rule wins (ties: block,
    then the smaller text) and gives the verdict; with none the rule is null and the verdict default.

    Null URLs and those without :// have empty host and path and get the default. Long URLs are
    read whole. Repeated rows and equal keys are judged one by one; an empty table gives an empty
    result. Other columns are not looked at.
    """
    verdicts = {r.rule: r.verdict for r in reversed(ranked(rules))}  # of one rule's verdicts the first counts
    names = tuple(reversed(verdicts))

    def winner(host: pd.Series, path: pd.Series) -> pd.Series:
        fits = _compiled(names).match([f".{h}{p}".encode() for h, p in zip(host, path)])
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
        return pd.Series([names[i] if i >= 0 else None for i in first], dtype=object)

    host, path = host_and_path(F.col(url))
    out = df.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    out = out.withColumn("rule", F.pandas_udf(winner, "string")("host", "path") if names else F.lit(None).cast("string"))
    verdict = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair])[F.col("rule")] if names else F.lit(None)
    return out.withColumn("verdict", F.coalesce(verdict, F.lit(default)))
