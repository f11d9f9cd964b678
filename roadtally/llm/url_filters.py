"""URL filters by a sorted digest array.

Each rule (host and path prefix) has a 64-bit xxhash key. The keys lie sorted in one file that
tasks map into memory, with the rules' full strings beside them. A url gives a candidate for each
of its host's suffixes and each path length that rules have; a batch's distinct candidates are probed
with one vectorised binary search, and a hit counts only if the stored string is the candidate itself.
The longest rule wins; of rules with equal text the blocking one.

Rules are a list of bounded length (``MAX_RULES``), a few tens of bytes each; the url table may be of any size.

Defined results: a url that is null or has no :// has an empty host and path; without a fitting
rule the verdict is ``default``; repeated rows each get their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 5_000_000
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_LOWER = "abcdefghijklmnopqrstuvwxyz"
OUT = "page_id long, host string, path string, rule string, verdict string"


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    start = url.find("://") if url else -1
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_TO_LOWER), slash + path


_TO_LOWER = str.maketrans(_LOWER.upper(), _LOWER)


class DigestArray:
    """Sorted keys and their strings, mapped from the files that build() wrote."""

    @staticmethod
    def build(rules, folder: str, name: str) -> list[str]:
        verdicts: dict[str, str] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            text = host.translate(_TO_LOWER) + slash + path
            verdicts[text] = "block" if "block" in (verdict, verdicts.get(text)) else "allow"
        if len(verdicts) > MAX_RULES:
            raise ValueError(f"{len(verdicts)} rules; at most {MAX_RULES}")
        rows = sorted((xxhash.xxh64_intdigest(t), t.encode(), v == "block") for t, v in verdicts.items())
        lengths = sorted({len(t) - len(t.partition("/")[0]) for t in verdicts})
        arrays = {
            "keys": np.array([r[0] for r in rows], np.uint64),
            "ends": np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
            "text": np.frombuffer(b"".join(r[1] for r in rows) or b"\0", np.uint8),
            "block": np.array([r[2] for r in rows], np.uint8),
            "lengths": np.array(lengths, np.int64),
        }
        files = []
        for kind, array in arrays.items():
            np.save(path := os.path.join(folder, f"{name}-{kind}.npy"), array)
            files.append(path)
        return files

    def __init__(self, place, name: str):
        self.keys, self.ends, self.text, self.block, self.lengths = (np.load(place(f"{name}-{kind}.npy"), mmap_mode="r") for kind in ("keys", "ends", "text", "block", "lengths"))

    def find(self, candidates: list[str]) -> list[int]:
        """Row of each candidate, or -1. Rows with equal keys stand together and are all compared."""
        if not len(self.keys) or not candidates:
            return [-1] * len(candidates)
        probe = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        at = np.searchsorted(self.keys, probe)
        out = [-1] * len(candidates)
        hit = np.nonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe)[0]
        for k in hit[at[hit] < len(self.keys)].tolist():
            row, own = int(at[k]), candidates[k].encode()
            while row < len(self.keys) and self.keys[row] == probe[k]:
                if self.text[self.ends[row] : self.ends[row + 1]].tobytes() == own:
                    out[k] = row
                    break
                row += 1
        return out


def candidates_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Strings of the rules that would fit, longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return sorted((h + p for h in hosts for p in prefixes), key=lambda x: (-len(x), x))


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, the longest fitting rule and the verdict."""
    spark: SparkSession = pages.sparkSession
    name = f"urlrules-{uuid.uuid4().hex}"
    for file in DigestArray.build(rules, tempfile.mkdtemp(prefix="urlrules-"), name):
        spark.sparkContext.addFile(file)  # Spark hands it to every executor

    def judge(batches):
        table = DigestArray(SparkFiles.get, name)
        lengths = table.lengths.tolist()
        for batch in batches:
            parts = [parts_of(u) for u in batch["url"]]
            lists = {hp: candidates_of(*hp, lengths) for hp in {(h, p[: lengths[-1] if lengths else 0]) for h, p in parts}}
            distinct = list({c for of in lists.values() for c in of})
            row = dict(zip(distinct, table.find(distinct)))
            best = {hp: next((c for c in of if row[c] >= 0), None) for hp, of in lists.items()}
            rule = [best[h, p[: lengths[-1] if lengths else 0]] for h, p in parts]
            verdict = [default if r is None else "block" if table.block[row[r]] else "allow" for r in rule]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": pd.Series(rule, dtype=object), "verdict": verdict})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInPandas(judge, OUT)


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
