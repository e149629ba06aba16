"""A single-core baseline: the comparison and the reading of amounts as plain loops over Python lists with the standard library.

No speed of the original tool is published, so this is what the engine's figures are held against: the same pairs of
versions at the same scale, one process, no Spark. ``python baseline.py [sf_dir]`` prints one JSON line.
"""

from __future__ import annotations

import difflib
import json
import os
import re
import sys
import time
from collections import defaultdict

import pyarrow.parquet as pq

AMOUNT = re.compile(r"\$\d{1,3}(?:,\d{3})+|\$\d+")  # fixed value


def load(sf_dir: str) -> dict:
    """bill, version to its nodes in order: of a node loaded several times the last."""
    names = {(r["bill_id"], r["version_label"]): r["version_no"] for r in pq.read_table(f"{sf_dir}/bill_versions.parquet").to_pylist() if r["version_no"] is not None}
    last: dict = {}
    for r in pq.read_table(f"{sf_dir}/bill_nodes.parquet", columns=["node_id", "bill_id", "version_no", "version_label", "node_ord", "match_path", "division_label", "body_text", "loaded_at"]).to_pylist():
        version = r["version_no"] if r["version_no"] is not None else names.get((r["bill_id"], r["version_label"]))
        key = (r["bill_id"], version, r["node_ord"])
        at = (r["loaded_at"] is not None, r["loaded_at"], r["node_id"])
        if version is not None and (key not in last or at > last[key][0]):
            last[key] = (at, r)
    out: dict = defaultdict(lambda: defaultdict(list))
    for (bill, version, _), (_, r) in sorted(last.items(), key=lambda x: x[0]):
        out[bill][version].append((tuple(r["match_path"] or ()), (r["division_label"] or "").partition(":")[2].strip().lower(), " ".join((r["body_text"] or "").split())))
    return out


def ratio(a: str, b: str, least: float = 0.0) -> float:
    m = difflib.SequenceMatcher(None, a.split(), b.split())
    return 0.0 if least and min(m.real_quick_ratio(), m.quick_ratio()) < least else m.ratio()


def greedy(scored: list) -> list:
    left, right, out = set(), set(), []
    for _, i, j in sorted(scored, reverse=True):
        if i not in left and j not in right:
            left.add(i), right.add(j), out.append((i, j))
    return out


def compare(old: list, new: list) -> dict:
    """How many changes of each type two versions have."""
    groups: dict = defaultdict(lambda: ([], []))
    for side, nodes in enumerate((old, new)):
        for n in nodes:
            groups[n[0]][side].append(n)
    count: dict = defaultdict(int)
    gone, come = [], []
    for a, b in groups.values():
        made = []
        for same in (True, False):
            used = {i for i, _ in made}, {j for _, j in made}
            open_ = [(i, j) for i, x in enumerate(a) if i not in used[0] for j, y in enumerate(b) if j not in used[1] and (not same or x[1] == y[1])]
            lone = len(a) == len(b) == 1
            made += greedy([(1.0 if lone else ratio(a[i][2], b[j][2]), i, j) for i, j in open_])
        for i, j in made:
            x, y = a[i][2], b[j][2]
            if x == y:
                count["unchanged"] += 1
            elif ratio(x, y) >= 0.4:
                count["modified"] += 1
            else:
                gone.append(x), come.append(y)
        gone += [x[2] for i, x in enumerate(a) if i not in {i for i, _ in made}]
        come += [y[2] for j, y in enumerate(b) if j not in {j for _, j in made}]
    moves = greedy([(s, i, j) for j, y in enumerate(come) for i, x in enumerate(gone) if (s := ratio(x, y, 0.6)) >= 0.6])
    count["moved"], count["removed"], count["added"] = len(moves), len(gone) - len(moves), len(come) - len(moves)
    return count


def main(sf_dir: str) -> dict:
    began = time.time()
    total: dict = defaultdict(int)
    for versions in load(sf_dir).values():
        order = sorted(versions)
        for a, b in zip(order, order[1:]):
            for k, n in compare(versions[a], versions[b]).items():
                total[k] += n
    seconds = {"compare_changes": round(time.time() - began, 3)}
    began = time.time()
    amounts = 0
    t = pq.read_table(f"{sf_dir}/node_changes.parquet", columns=["old_text", "new_text"])
    for c in ("old_text", "new_text"):
        amounts += sum(len(AMOUNT.findall(x)) for x in t[c].to_pylist() if x)
    seconds["extract_amounts"] = round(time.time() - began, 3)
    return {"baseline": "one core, standard library", "unit": "sec", "queries": seconds, "changes": dict(total), "amounts": amounts, "sf": os.path.basename(sf_dir.rstrip("/"))}


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1] if len(sys.argv) > 1 else os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))))
