"""A passage that many documents share in different surroundings: its owners spread over buckets."""

import itertools

import numpy as np
import pyarrow as pa

from hazardspark.llm.arrays import chunks
from hazardspark.llm.runs import OPEN, SPAN, SPANS, Windows, find_runs, open_branches, pack, short, table, unpack


def test_windows_of_one_owner_spread():
    other = itertools.count()
    passage = [f"p{i}" for i in range(30)]
    around = lambda: [f"w{next(other)}" for _ in range(25)]
    docs = pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": [" ".join(around() + passage + around()) for _ in range(300)]})
    how = Windows(20, 8, True, True)
    runs = []
    for chunk in chunks(docs.combine_chunks()):
        r = find_runs(chunk, how)
        runs.append((chunk.doc[r.row], r.place, short(r.n, 1), short(r.owner, 5), np.zeros(len(r.row), np.int32)))
    flags = table([(0, OPEN, pack(*(np.concatenate(x) for x in zip(*runs))))])
    out = open_branches(how, 16)(None, docs, flags).to_pylist()
    parts, removed = {}, 0
    for row in out:
        if row["kind"] == SPANS:
            assert row["part"] >= 16
            removed += int(unpack(row["payload"], *SPAN)[2].sum())
            continue
        for content in unpack(row["payload"], np.uint64, np.int64, np.int32)[0]:
            parts.setdefault(row["part"], []).append(int(content))
    windows = [c for p in parts.values() for c in p]
    assert len(parts) == 16 and len(set(windows)) == len(windows) and removed == 299 * 11
