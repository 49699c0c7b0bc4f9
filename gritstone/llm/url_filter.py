"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Each rule is a glob over the canonical form ``.host`` + boundary byte + ``path``. All rules are laid
end to end in one bit vector of 64-bit words; an extended Shift-And step moves every rule one
character forward at once, and a batch of URLs is stepped together with numpy:

    D = ((D << 1 | starts) & step[c]) | (D & loop[c])

``*`` stands for any bytes of the same part (it does not cross the boundary), ``**`` for any bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, mapped

#: Between host and path; it cannot be part of either glob.
BOUNDARY = 0x01


@dataclass(frozen=True)
class HostRule:
    """A rule on a host with all its subdomains and a path prefix, written like ``net/``."""

    text: str
    verdict: str

    @property
    def glob(self) -> bytes:
        host, slash, path = self.text.partition("/")
        return b"*." + host.lower().encode() + bytes([BOUNDARY]) + (slash + path).encode() + b"**"


@dataclass(frozen=True)
class GlobRule:
    """A rule given as a glob over ``.host<boundary>path``."""

    text: str
    verdict: str

    @property
    def glob(self) -> bytes:
        return self.text.encode()


#: Fixed values of the contract.
HOST_RULES = (
    HostRule("net/", "block"),
    HostRule("example.net/en/", "allow"),
    HostRule("example.com/de/", "block"),
    HostRule("org/fr/", "allow"),
)

#: The filter's own rules, used where no host rule fits: spam words in a host, trackers, binaries.
OWN_RULES = tuple(
    GlobRule(x, "block")
    for x in ("**casino**", "**free-bets**", "**cheap-pills**", "**poker**", "**viagra**", "**porn**", "*.ads.**", "*.tracker.**", "**.exe", "**.zip", "**/wp-login**")
)


class Automaton:
    """All globs in one multiword Shift-And state; ``run`` gives a hit matrix (urls x globs)."""

    def __init__(self, globs: list[bytes]):
        cells: list[tuple[int, bool, bool]] = []  # (byte to consume, loops in part, loops anywhere) for each position
        self.starts: list[int] = []
        self.ends: list[int] = []
        for glob in globs:
            self.starts.append(len(cells))
            k, inside, anywhere = 0, False, False
            # Position 0 of each rule is its start state; a loop flag belongs to the state before the next byte.
            cells.append((-1, False, False))
            while k < len(glob):
                if glob[k] == 0x2A:
                    wide = glob[k : k + 2] == b"**"
                    inside, anywhere = True, anywhere or wide
                    k += 2 if wide else 1
                    byte, was_in, was_any = cells[-1]
                    cells[-1] = (byte, was_in or inside, was_any or anywhere)
                    inside = anywhere = False
                else:
                    cells.append((glob[k], False, False))
                    k += 1
            self.ends.append(len(cells) - 1)
        self.words = max(1, -(-len(cells) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for k, (byte, inside, anywhere) in enumerate(cells):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if byte >= 0:
                self.step[byte, word] |= bit
            if inside or anywhere:
                for c in range(256):
                    if anywhere or c != BOUNDARY:
                        self.loop[c, word] |= bit
        for k in self.starts:
            self.first[k // 64] |= np.uint64(1 << (k % 64))

    def run(self, urls: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        offsets = np.r_[0, np.cumsum(sizes)][:-1][order]
        left = sizes[order]
        state = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        # URLs run from long to short, so those still being read are always a leading slice.
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
        for k, n in enumerate(active.tolist()):
            c = flat[offsets[:n] + k]
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.zeros((len(urls), len(self.ends)), bool)
        for r, end in enumerate(self.ends):
            out[order, r] = (state[:, end // 64] >> np.uint64(end % 64)) & one != 0
        return out


def filter_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    own_rules: tuple[GlobRule, ...] = OWN_RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
    path from there to ``?``, ``#`` or the end. Null urls and urls without ``://`` have both empty,
    fit no host rule, and get the default verdict. Of the host rules that fit, the longest decides
    (of equal length, the one listed first); else ``rule`` is null and the filter's own globs
    decide, then the default. URLs may be of any length; a batch's state grows with its number of URLs,
    not with their length. Repeated rows stay, an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    source = pages.select(column_or_null(pages, id_col, "bigint").alias("page_id"), F.coalesce(column_or_null(pages, url_col, "string"), F.lit("")).alias("url"))
    after = F.when(F.instr("url", "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1)).otherwise("")
    source = source.withColumn("rest", F.substring_index(after, "?", 1))
    host = F.translate(F.substring_index("rest", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    source = source.select("page_id", host.alias("host"), F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)").alias("path"))

    automaton = Automaton([r.glob for r in (*host_rules, *own_rules)])
    ranked = sorted(range(len(host_rules)), key=lambda k: (len(host_rules[k].text), -k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hits = automaton.run([b"." + h.encode() + bytes([BOUNDARY]) + p.encode() if h else b"" for h, p in zip(hosts, paths, strict=True)])
            rule = np.full(batch.num_rows, None, object)
            verdict = np.full(batch.num_rows, default, object)
            for k, r in enumerate(own_rules):
                verdict[hits[:, len(host_rules) + k]] = r.verdict
            for k in ranked:  # the longest comes last and wins
                rule[hits[:, k]], verdict[hits[:, k]] = host_rules[k].text, host_rules[k].verdict
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule.tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())], names=["page_id", "host", "path", "rule", "verdict"]
            )

    return mapped(source, run, "page_id bigint, host string, path string, rule string, verdict string")
