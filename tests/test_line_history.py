"""Line history against a replay of real diffs."""

import datetime as dt
import difflib
import random

import pytest

from strata.operators import line_history as LH


def versions(rng, n):
    """Successive texts of one file, oldest first."""
    lines, out = [], [[]]
    for v in range(n):
        lines = list(lines)
        for _ in range(rng.randint(0 if v else 2, 4)):
            at, kind = rng.randint(0, len(lines)), rng.random()
            if kind < 0.5 or not lines:
                lines[at:at] = [f"line {v} {rng.randint(0, 99)}" for _ in range(rng.randint(1, 5))]
            elif kind < 0.75:
                del lines[at:at + rng.randint(1, 3)]
            else:
                lines[at:at + 2] = [f"edit {v} {rng.randint(0, 99)}" for _ in range(rng.randint(1, 3))]
        out.append(lines)
    return out


def replay(texts, number, most):
    """(commit index newest first, line there, made) of the commits that touched the line."""
    out, at = [], number - 1
    for v in range(len(texts) - 1, 0, -1):
        old, new = texts[v - 1], texts[v]
        blocks = []  # adjoining changes are one stretch of a diff
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            if tag != "equal":
                blocks.append((i1, i2, j1, j2))
        shift = 0
        for i1, i2, j1, j2 in blocks:
            if j1 <= at < j2:
                out.append((v, at + 1, i1 == i2))
                if i1 == i2 or len(out) == most:
                    return out
                at = i1 + min(at - j1, i2 - i1 - 1)
                break
            if at >= j2:
                shift += (i2 - i1) - (j2 - j1)
        else:
            at += shift
    return out


@pytest.mark.parametrize("context,pieces", [(3, 20_000), (0, 5)])
def test_replay_of_every_diff(spark, monkeypatch, context, pieces):
    monkeypatch.setattr(LH, "REQUESTS_AT_ONCE", pieces)
    rng = random.Random(context)
    diffs, asked, want = [], [], {}
    for f in range(12):
        path, texts = (None if f == 0 else f"f{f}"), versions(rng, rng.randint(1, 30))
        for v in range(1, len(texts)):
            text = "\n".join(difflib.unified_diff(texts[v - 1], texts[v], "a", "b", n=context, lineterm=""))
            diffs.append(("r", path, f"{f:02d}{v:038d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=v), text or None))
        for number in range(1, len(texts[-1]) + 1):
            asked += [("r", path, number)] * rng.randint(1, 2)
            want["r", path, number] = [(f"{f:02d}{v:038d}", at, made) for v, at, made in replay(texts, number, 6)]
        asked.append(("r", path, 10_000))
    blocks = LH.change_blocks(spark.createDataFrame(diffs, "repo_id string, file_path string, commit string, ts timestamp, diff string"))
    requests = spark.createDataFrame(asked, "repo_id string, file_path string, line_number int")
    got = {}
    for r in sorted(LH.line_touches(requests, blocks.repartition(7), 6).collect(), key=lambda r: r.step):
        mine = got.setdefault((r.repo_id, r.file_path, r.line_number), [])
        assert r.step == len(mine) + 1
        mine.append((r.commit, r.line_at, r.made))
    assert got == want
    assert sum(len(x) > 1 for x in want.values()) > 10


def test_change_blocks(spark):
    text = ("diff --git a b\n--- a/f\n+++ b/f\n@@ -0,0 +1,2 @@\n+a\n+b\n@@ -5,3 +7,2 @@ def f(): @@ -1 +1 @@\n x\n-y\n z\n"
            "@@ -20 +21 @@\n-old\n\\ No newline at end of file\n+new\n@@ -30,2 +31,0 @@\n-p\n-q")
    df = spark.createDataFrame([("r", "f", "c", dt.datetime(2024, 1, 1), text), ("r", "g", "c", dt.datetime(2024, 1, 1), None)],
                               "repo_id string, file_path string, commit string, ts timestamp, diff string")
    got = sorted((r.old_start, r.old_len, r.new_start, r.new_len) for r in LH.change_blocks(df).collect())
    assert got == [(1, 0, 1, 2), (6, 1, 8, 0), (20, 1, 21, 1), (30, 2, 32, 0)]


def test_requests_without_diffs_get_the_file(spark):
    ts = dt.datetime(2024, 1, 1)
    commits = spark.createDataFrame([("r", "f", "c" * 40, "a", ts, "rename y", 1, 0), ("r", "g", "d" * 40, "a", ts, "fix", 1, 0),
                                     ("r", "g", "e" * 40, "a", ts + dt.timedelta(1), "move", 1, 0)],
                                    "repo_id string, file_path string, commit string, author string, ts timestamp, message string, insertions int, deletions int")
    diffs = spark.createDataFrame([("r", "f", "c" * 40, ts, "@@ -0,0 +1 @@\n+x")], "repo_id string, file_path string, commit string, ts timestamp, diff string")
    asked = spark.createDataFrame([("r", "f", 1), ("r", "g", 4), ("r", "f", 9), ("r", "none", 1)], "repo_id string, file_path string, line_number long")
    got = sorted((r.file_path, r.line_number, r.step, r.change_type, r.source) for r in LH.line_history(asked, diffs, commits).collect())
    assert got == [("f", 1, 1, "introduction", "line"), ("f", 9, 1, "introduction", "file"),
                   ("g", 4, 1, "refactor", "file"), ("g", 4, 2, "introduction", "file")]
    assert LH.line_history(asked.filter("line_number > 99"), diffs, commits).collect() == []
