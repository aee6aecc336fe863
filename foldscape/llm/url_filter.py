"""URL rules in a sorted digest array.

A rule is a verdict, a host and a path.  It fits its host and every subdomain, where
the URL's path starts with the rule's; the longest rule wins (of equal length, the one
with the longer host).  Rules are stored by the 64-bit xxhash of host + path, sorted, in
memory-mapped files: ``keys`` (unsigned 64-bit), ``offsets`` (64-bit) into ``strings``
(UTF-8) and ``verdicts`` (one byte).  A batch of URLs asks for every suffix of its hosts
with every path prefix of a length that some rule has, in one vectorised binary search;
a key that is found counts only if the stored string is the same.

Defined results: a null URL or one without "://" has empty host and path and fits no
rule; where no rule fits the verdict is the default.  Repeated rules: the last given
counts.  A very long URL is judged whole.  Other columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import add_from_text, filesystem, map_array, shared_folder, write_bytes

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(65, 91)}
VERDICTS = ("allow", "block")


def split_url(url: str) -> tuple[str, str]:
    """(host with A-Z lower-cased, path), both empty without "://"."""
    m = _PARTS.search(url)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode())


def write_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]], folder: str | None = None) -> str:
    """Writes (verdict, host, path) rules as a sorted digest array; returns its folder.

    The rules are a parameter held on the driver: some 100 bytes each, so tens of millions at most.
    """
    folder = folder or shared_folder(spark, "urls")
    last = {host.translate(_LOWER) + path: (verdict, len(host), len(path)) for verdict, host, path in rules}
    rows = sorted((digest(k), k, *v) for k, v in last.items())
    blobs = [k.encode() for _, k, *_ in rows]
    write_bytes(f"{folder}/keys", [np.array([r[0] for r in rows], dtype="<u8").tobytes()])
    write_bytes(f"{folder}/offsets", [np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype("<i8").tobytes()])
    write_bytes(f"{folder}/strings", [b"".join(blobs)])
    write_bytes(f"{folder}/verdicts", [bytes(VERDICTS.index(r[2]) for r in rows)])
    write_bytes(f"{folder}/lengths.json", [json.dumps(sorted({r[4] for r in rows})).encode()])
    return folder


class UrlRules:
    """The rules of a folder, memory-mapped."""

    def __init__(self, folder: str):
        self.keys = map_array(f"{folder}/keys", "<u8")
        self.offsets = map_array(f"{folder}/offsets", "<i8")
        self.strings = map_array(f"{folder}/strings", np.uint8)
        self.verdicts = map_array(f"{folder}/verdicts", np.uint8)
        where, path = filesystem(f"{folder}/lengths.json")
        with where.open_input_file(path) as f:
            self.lengths: list[int] = json.loads(f.read())

    def stored(self, k: int) -> str:
        return self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes().decode()

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of each (host, path), or None."""
        asked: list[str] = []
        owner: list[int] = []
        hosts: list[int] = []
        for i, (host, path) in enumerate(urls):
            at = 0
            while host:
                for n in self.lengths:
                    if n <= len(path):
                        asked.append(host[at:] + path[:n])
                        owner.append(i)
                        hosts.append(len(host) - at)
                at = host.find(".", at) + 1
                if not at:
                    break
        found: list[tuple[int, int, str, str] | None] = [None] * len(urls)
        if asked and len(self.keys):
            want = np.fromiter(map(digest, asked), dtype=np.uint64, count=len(asked))
            k = np.searchsorted(self.keys, want)
            for j in np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] == want).tolist():
                at = int(k[j])
                while at < len(self.keys) and self.keys[at] == want[j]:
                    if self.stored(at) == asked[j]:
                        new = (len(asked[j]), hosts[j], asked[j], VERDICTS[self.verdicts[at]])
                        old = found[owner[j]]
                        found[owner[j]] = new if old is None or new > old else old
                    at += 1
        return [x and x[2:] for x in found]


_open: dict[str, UrlRules] = {}


def filter_urls(pages: DataFrame, folder: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict."""

    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        if folder not in _open:
            _open[folder] = UrlRules(folder)
        for column in columns:
            urls = [split_url(u or "") for u in column.to_pylist()]
            got = _open[folder].judge(urls)
            yield [
                pa.array([h for h, _ in urls], type=pa.string()),
                pa.array([p for _, p in urls], type=pa.string()),
                pa.array([x and x[0] for x in got], type=pa.string()),
                pa.array([x[1] if x else default for x in got], type=pa.string()),
            ]

    return add_from_text(pages, work, "host string, path string, rule string, verdict string", url_col)
