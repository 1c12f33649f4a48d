"""URL filters: all wildcard rules at once over each canonical URL, bit-parallel.

A canonical URL is ``.host/path`` with the host's A-Z in lower case.  Rules are globs over it:
``*`` stands for any run without ``/``, ``**`` for any run at all, everything else for itself.
All globs are packed, one state bit per literal byte and one for the start of each glob, into
the words of one Shift-And automaton: a step shifts the state word, keeps the bits whose
byte fits, and lets the bits before a wildcard stand.  One pass over a URL tells every rule
that fits it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64

# The rules of the contract, and the names that make a host suspect.
LIST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
              ("com/fr/", "allow"), ("com/de/", "block")]
HOST_GLOBS = ["*adult*", "*casino*", "*porn*", "*spam*", "*xxx*", "*gambl*", "*phish*", "*malware*"]


class Automaton:
    """Shift-And over bytes for a list of globs."""

    def __init__(self, globs: list[str]):
        states: list[tuple[int | None, str | None]] = []  # (literal byte, wildcard that follows)
        self.first, self.last = [], []
        for glob in globs:
            raw, i = glob.encode(), 0
            self.first.append(len(states))
            states.append((None, None))
            while i < len(raw):
                if raw[i:i + 1] == b"*":
                    wide = raw[i:i + 2] == b"**"
                    byte, old = states[-1]
                    states[-1] = (byte, "any" if wide or old == "any" else "run")
                    i += 2 if wide else 1
                else:
                    states.append((raw[i], None))
                    i += 1
            self.last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.step, self.stay = np.zeros((256, self.words), _U), np.zeros((256, self.words), _U)
        self.start = np.zeros(self.words, _U)
        for k, (byte, wildcard) in enumerate(states):
            w, bit = k // 64, _U(1) << _U(k % 64)
            if byte is None:
                self.start[w] |= bit
            else:
                self.step[byte, w] |= bit
            if wildcard:
                self.stay[:, w] |= bit
                if wildcard == "run":
                    self.stay[ord("/"), w] &= ~bit

    def run(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs fit each string of the buffer, ``bool[strings, globs]``."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")  # longest first: the live ones are a prefix
        state = np.repeat(self.start[None, :], n, axis=0)
        at, live = offsets[:-1][order], n
        rising = -sizes[order]
        for j in range(int(sizes.max()) if n else 0):
            live = int(np.searchsorted(rising, -j, side="left"))
            byte = raw[at[:live] + j]
            old = state[:live]
            moved = old << _U(1)
            if self.words > 1:
                moved[:, 1:] |= old[:, :-1] >> _U(63)
            state[:live] = (moved & self.step[byte]) | (old & self.stay[byte])
        fits = np.empty((n, len(self.last)), bool)
        for g, k in enumerate(self.last):
            fits[order, g] = (state[:, k // 64] >> _U(k % 64)) & _U(1) != 0
        return fits


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without one."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path




def _judge(rules: list[tuple[str, str]], host_globs: list[str]):
    texts = [r for r, _ in rules]
    globs = [f"*.{r}**" for r in texts] + [f".{g}/**" for g in host_globs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        sizes = np.array([len(t) for t in texts])
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            # A host's globs need the slash that ends it; an empty path gets one of its own.
            names = [f".{h}{p}".encode() for h, p in parts]
            bare = [f".{h}/".encode() for h, _ in parts]
            fits = automaton.run(*_buffer(names))[:, :len(texts)]
            odd = automaton.run(*_buffer(bare))[:, len(texts):].any(axis=1)
            length = np.where(fits, sizes, -1)
            best = length.argmax(axis=1) if len(texts) else np.zeros(len(parts), int)
            hit = fits.any(axis=1) if len(texts) else np.zeros(len(parts), bool)
            rule = [texts[b] if h else None for b, h in zip(best, hit)]
            verdict = [rules[b][1] if h else "block" if o else "allow" for b, h, o in zip(best, hit, odd)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])
    return run


def _buffer(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in names], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(names), dtype=np.uint8), offsets


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = LIST_RULES, host_globs: list[str] = HOST_GLOBS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``rules`` are (host and path prefix, verdict): a rule fits its host and all subdomains if
    the path starts with the rule's; of those that fit the longest wins (then the first
    given).  Without one, ``rule`` is null and the host is judged by ``host_globs``: block if
    one fits, else allow.  Null urls and urls without ``://`` have an empty host and path and
    are allowed.  Rows are judged one by one (repeated rows and null ids alike); other
    columns are ignored; an empty table gives no rows.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(
        _judge(list(rules), list(host_globs)), "page_id long, host string, path string, rule string, verdict string")
