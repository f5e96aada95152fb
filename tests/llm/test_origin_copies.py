from datetime import datetime

import numpy as np

from coppice.llm import origin


def test_a_copy_with_a_long_repetitive_block_is_compared(spark):
    words = ["[UNK]"] * 9 + ["\n\n", "\n", "        ", "    ", "  ", " "] + [f"w{k}" for k in range(300)]
    lib = np.random.default_rng(5).integers(15, 300, 200)
    files = {1: lib, 2: np.concatenate([lib, np.tile([20, 21, 22, 23], 200)]), 3: np.random.default_rng(6).integers(15, 300, 200)}
    rows = [(k, d.tolist(), "o/r", f"r-main/src/{k}.py", datetime(2026, 1, 1)) for k, d in files.items()]
    df = spark.createDataFrame(rows, "file_id long, data array<int>, repository string, path string, ingested_at timestamp_ntz")
    e = f"e_{origin.STATES[origin.COPY]}"
    got = {r["file_id"]: r[e] for r in origin.evidence(df, dict(enumerate(words)), [("lib/lib", "lib/f.py", lib)]).collect()}
    assert got[1] == got[2] > 0 > got[3]
