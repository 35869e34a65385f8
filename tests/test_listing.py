"""A tree listed by tasks in rounds against the listing of one thread."""

import random

from lodestone.runtime import Scratch
from lodestone.sources.files import folders, list_in_rounds, scan, scan_in_rounds


def test_large_tree_with_nested_ignore_files(spark, tmp_path):
    """100 000 files: deep, wide and lone folders, each with rules of its own now and then."""
    rng = random.Random(1)
    root, n = tmp_path / "tree", 0
    root.mkdir()
    (root / ".git").mkdir()
    (root / ".gitignore").write_text("*.gen.py\n/top*/skip/\n!kept.gen.py\n")
    work = [(root, 0)]
    while n < 100_000:
        at, depth = work.pop(rng.randrange(len(work))) if work else (root / f"top{n}", 0)
        at.mkdir(exist_ok=True)
        if rng.random() < 0.1:
            (at / rng.choice((".gitignore", ".ignore"))).write_text(rng.choice(("b*.py\n", "!b1.py\n", "sub1/\n", "/sub2\n", "**/a3.py\n", "# none\n\n*.md\n!a*.md\n")))
        for k in range(rng.choice((0, 20, 300, 2000))):
            (at / f"{rng.choice('ab')}{k}.{rng.choice(('py', 'py', 'md', 'gen.py', 'bin'))}").touch()
            n += 1
        for k in range(rng.randrange(6) if depth < 7 else 0):
            work.append((at / rng.choice((*[f"sub{k}"] * 12, "skip", "node_modules", ".hidden")), depth + 1))
    want = {f"{base}/{x}" if base else x for base, names in folders(str(root)) for x in names}
    scratch = Scratch(spark, "listing")
    got = [r[0] for r in list_in_rounds(spark, str(root), scratch, limit=3000).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 10_000 < len(want) < n


def test_same_rows_as_the_data_source(spark, tmp_path):
    root = tmp_path / "tree"
    for k in range(60):
        path = root / f"d{k % 7}/e{k % 3}/f{k}.{('py', 'md', 'rs')[k % 3]}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text {k}")
    (root / "bad.py").write_bytes(b"\xff")
    (root / "d1/.gitignore").write_text("e1\n")
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(scan_in_rounds(spark, str(root), Scratch(spark, "scan"), limit=1))
    assert got == rows(scan(spark, str(root))) and len(got) > 40
    (tmp_path / "empty").mkdir()
    assert rows(scan_in_rounds(spark, str(tmp_path / "empty"), Scratch(spark, "scan"))) == []
    assert rows(scan_in_rounds(spark, str(tmp_path / "missing"), Scratch(spark, "scan"))) == []
