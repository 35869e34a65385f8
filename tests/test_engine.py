"""Imports, graph, search and maintenance on a small project."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, imports, incremental, resolve, search, vectors
from lodestone.plans import render
from lodestone.plans.engine import Engine
from lodestone.plans.query import Clause, Group, QueryError, parse
from lodestone.schemas import FS_EVENTS
from lodestone.sources.files import IgnoreRules, folders, read_file, scan
from lodestone.sources import warehouse
from lodestone.sources.warehouse import SupersededError
from lodestone.streaming import watch

PROJECT = {
    "src/main.rs": "use crate::net::{dial, self};\nuse crate::store::Store;\n// use crate::ghost;\nfn main() {}",
    "src/net/mod.rs": "use super::store::Store;\npub fn dial() {}",
    "src/store.rs": "pub struct Store;\nimpl Store {\n  pub fn load() {}\n}",
    "web/a.ts": "import { b } from './b';\nexport function alpha() {}",
    "web/b.ts": "import './a';\nexport const beta = 1;",
    "docs/guide.md": "How the store is loaded.\nThe store keeps records.",
    "pkg/__init__.py": "",
    "pkg/m.py": "from . import util\nimport pkg.util\ndef run(): pass",
    "pkg/util.py": "def helper(): pass",
}


def frame(spark, project):
    rows = [(p, c, p.rpartition(".")[2], not p.endswith(".md"), str(hash(c))) for p, c in project.items()]
    return spark.createDataFrame(rows, "relative_path string, content string, extension string, is_code boolean, content_hash string")


@pytest.fixture(scope="module")
def edges(spark):
    files = frame(spark, PROJECT)
    return resolve.edges(files, imports.extract_imports(files)).persist()


def test_edges(edges):
    assert {(r.src, r.dst) for r in edges.collect()} == {
        ("src/main.rs", "src/net/mod.rs"), ("src/main.rs", "src/store.rs"), ("src/net/mod.rs", "src/store.rs"),
        ("web/a.ts", "web/b.ts"), ("web/b.ts", "web/a.ts"), ("pkg/m.py", "pkg/__init__.py"), ("pkg/m.py", "pkg/util.py"),
    }


def test_graph_queries(edges):
    assert [r.dst for r in graph.deps(edges, "src/main.rs").collect()] == ["src/net/mod.rs", "src/store.rs"]
    assert [r.src for r in graph.dependents(edges, "src/store.rs").collect()] == ["src/main.rs", "src/net/mod.rs"]
    assert [r.cycle for r in graph.cycles(edges).collect()] == [["web/a.ts", "web/b.ts"]]
    assert {(r.path, r.depth) for r in graph.impact(edges, "src/store.rs").collect()} == {("src/main.rs", 1), ("src/net/mod.rs", 1)}
    assert [r.node for r in graph.shortest_path(edges, "src/main.rs", "src/store.rs").collect()] == ["src/main.rs", "src/store.rs"]
    assert graph.shortest_path(edges, "src/store.rs", "src/main.rs").count() == 0
    assert [r.node for r in graph.shortest_path(edges, "x", "x").collect()] == ["x"]
    assert graph.remove_file(edges, "web/a.ts").count() == 5


def test_impact_matches_paths(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 14) for k in range(14)] + [(20, 3)], "src long, dst long")
    reach = {r.path: r.depth for r in graph.impact(ring, 0).collect()}
    assert reach == {14 - d: d for d in range(1, 11)}
    assert [r.node for r in graph.shortest_path(ring, 20, 6).collect()] == [20, 3, 4, 5, 6]


def test_incremental_equals_full(spark):
    old = frame(spark, PROJECT)
    changed = {**PROJECT, "web/b.ts": "import './c';", "web/c.ts": "x"}
    del changed["pkg/util.py"]
    new = frame(spark, changed)
    changes = incremental.diff(incremental.manifest_of(old), incremental.manifest_of(new))
    assert incremental.counters(changes).first().asDict() == {"total_files": 9, "added": 1, "updated": 1, "deleted": 1, "needs_embedding": 2}
    _, edges = incremental.refresh_graph(imports.extract_imports(old), new, changes)
    full = resolve.edges(new, imports.extract_imports(new))
    assert {tuple(r) for r in edges.collect()} == {tuple(r) for r in full.collect()}


def test_scan_and_index_scores_agree(spark):
    docs = search.search_documents(frame(spark, PROJECT))
    tokens, boosts = {"content": ["store", "load"], "symbols": ["store"]}, {"content": 1.0, "symbols": 8.0}
    a = {r.relative_path: round(r.score, 9) for r in search.scan_scores(docs, tokens, boosts).collect()}
    b = {r.relative_path: round(r.score, 9) for r in search.index_scores(search.postings(docs), search.field_stats(docs), tokens, boosts).collect()}
    assert a == b and a


def test_fusion_is_symmetric_and_bounded(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "relative_path string, score double")
    b = spark.createDataFrame([("x", 0.9), ("z", 0.1)], "relative_path string, score double")
    left, right = search.fuse(a, b, 5).collect(), search.fuse(b, a, 5).collect()
    assert left == right and left[0].relative_path == "x" and abs(left[0].score - 2 / 61) < 1e-12


def test_query_language():
    assert parse('+a -b "c d" basename:e std::io x AND y NOT z') == [
        Clause("a", occur="must"), Clause("b", occur="not"), Clause("c d", True), Clause("e", field="basename"), Clause("std::io"),
        Clause("x", occur="must"), Clause("y", occur="must"), Clause("z", occur="not"),
    ]
    assert parse("") == [] and parse('""') == []
    assert parse('(a OR b)^2 AND basename:(c "d e"^3) std::io^0.5') == [
        Group((Clause("a"), Clause("b")), "must", 2.0),
        Group((Clause("c", field="basename"), Clause("d e", True, "basename", boost=3.0)), "must"), Clause("std::io", boost=0.5),
    ]
    assert parse("a AND NOT b") == [Clause("a", occur="must"), Clause("b", occur="not")]
    for bad in ('"open', "(a", "a)", "()", "a AND", "OR a", "NOT", "+", "a ^2", "x OR OR y", "nofield:(a)", "basename:"):
        with pytest.raises(QueryError):
            parse(bad)


def test_pooling():
    import numpy as np

    states = np.array([[[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]]], dtype=np.float32)
    assert np.allclose(vectors.mean_pool(states, np.array([[1, 1, 0]])), [[0.5**0.5, 0.5**0.5]])
    assert np.allclose(np.linalg.norm(vectors.HashedWords().embed(["a b", ""]), axis=1), [1, 0])


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "wh"), None, vectors.HashedWords)
    assert engine.refresh(frame(spark, PROJECT)).first().added == 9
    assert engine.refresh(frame(spark, PROJECT)).first().added == 0
    hits = engine.search("store loaded", "docs", 5).collect()
    assert [h.path for h in hits] == ["docs/guide.md"]
    assert engine.search('"the store"', None, 5).first().path == "docs/guide.md"
    assert all(h.path.endswith((".rs", ".ts", ".py")) for h in engine.search("store", "code", 5).collect())
    with pytest.raises(ValueError):
        engine.graph("deps", "missing.rs")
    with pytest.raises(ValueError):
        engine.graph("path", "src/main.rs")
    with pytest.raises(ValueError):
        engine.graph("explode")
    assert "web/b.ts" in render.render_graph("cycles", engine.graph("cycles"))
    status = engine.status().first()
    assert (status.documents, status.edges, status.readiness, status.model, status.task, status.watcher) == (9, 7, "hybrid", "loaded", "idle", "none")
    assert "web/a.ts" in render.render_search(engine.search("alpha", "code", 3)) and "documents" in render.render_status(engine.status())
    with pytest.raises(SupersededError):
        engine.warehouse.commit(0, edges=engine.warehouse.read("edges"))
    engine.apply(frame(spark, {"web/c.ts": "import './a'"}), spark.createDataFrame([("pkg/m.py",)], "relative_path string"))
    assert engine.status().first().documents == 9
    assert [r.src for r in engine.graph("dependents", "web/a.ts").collect()] == ["web/b.ts", "web/c.ts"]


def test_commits_write_what_changed(spark, tmp_path, monkeypatch):
    """Unchanged files are neither parsed nor written again; stale rows and vectors go, with or without a model."""
    engine = Engine(spark, str(tmp_path / "wh"), None, vectors.HashedWords)
    engine.refresh(frame(spark, PROJECT))
    assert engine.warehouse.read("vectors").select("relative_path").distinct().count() == 8  # an empty file has no chunk
    plain = Engine(spark, str(tmp_path / "wh"))
    changed = {**PROJECT, "web/b.ts": "import './c';", "web/c.ts": "x"}
    del changed["pkg/util.py"]
    plain.refresh(frame(spark, changed))
    state, read = plain.warehouse.state(), plain.warehouse.read
    for name in ("files", "postings", "imports", "manifest"):
        last = spark.read.parquet(f"{plain.warehouse.folder}/{state['tables'][name][-1][1]}").select("relative_path").distinct()
        assert {r[0] for r in last.collect()} <= {"web/b.ts", "web/c.ts"}, name
    assert {r[0] for r in read("files").select("relative_path").collect()} == set(changed)
    assert {r[0] for r in read("vectors").select("relative_path").collect()} == set(PROJECT) - {"pkg/util.py", "web/b.ts", "pkg/__init__.py"}
    full = Engine(spark, str(tmp_path / "other"))
    full.refresh(frame(spark, changed))
    for name in ("files", "postings", "field_stats", "imports", "edges", "manifest"):
        rows = [sorted(map(repr, e.warehouse.read(name).collect())) for e in (plain, full)]
        assert rows[0] == rows[1], name
    hits = [[tuple(r) for r in e.search("store load", None, 9).collect()] for e in (plain, full)]
    assert hits[0] == hits[1]
    monkeypatch.setattr(warehouse, "MAX_SEGMENTS", 3)
    for k in range(3):  # many small commits end in one segment again
        plain.apply(frame(spark, {"web/c.ts": f"x{k}"}), spark.createDataFrame([], "relative_path string"))
    assert len(plain.warehouse.state()["tables"]["files"]) <= 3 and read("files").count() == len(changed)
    assert read("files").where("relative_path = 'web/c.ts'").first().content == "x2"
    before = read("postings").count()
    assert plain.warehouse.vacuum(1) > 0 and read("postings").count() == before


def test_versions_are_immutable(spark, tmp_path):
    """Of two writers one is superseded; a version that was cut off is passed over."""
    first, second = (Engine(spark, str(tmp_path / "wh")).warehouse for _ in range(2))
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert first.commit(0, edges=edges) == 1
    with pytest.raises(SupersededError):
        second.commit(0, edges=edges)
    (tmp_path / "wh/versions/2.json").write_text('{"version": 2, "tab')
    assert second.state()["version"] == 1 and second.read("edges").count() == 1
    assert second.commit(1, edges=edges.union(edges)) == 3 and first.read("edges").count() == 2
    state = first.state()
    second.commit(3, edges=edges)
    with pytest.raises(SupersededError):  # written before, published after another
        first._publish(3, {"tables": state["tables"], "stale": []})
    assert first.read("edges").count() == 1


def test_background_embedding(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "wh"), None, vectors.HashedWords)
    engine.refresh(frame(spark, PROJECT), background=True)
    assert engine.progress["active"] or engine.progress["done"]
    engine.wait()
    assert engine.progress["error"] is None and engine.progress["done"] == engine.progress["total"] == 9
    once = engine.warehouse.read("vectors").count()
    engine.embed()
    assert engine.warehouse.read("vectors").count() == once and engine.progress["total"] == 1  # the empty file, which has no chunk
    hits = {r.path: r.snippet for r in engine.search("records keeps", "docs", 3).collect()}
    assert hits == {"docs/guide.md": PROJECT["docs/guide.md"]}
    old = dict(engine.progress)
    engine.progress = {**old, "generation": old["generation"] + 1}
    engine._embed(old, 1)  # superseded: nothing is committed
    assert engine.warehouse.read("vectors").count() == once


def test_hybrid_shows_the_nearest_chunk(spark, tmp_path):
    """A hit of its vectors alone shows its best chunk, not its first lines."""
    long = "\n\n".join(["filler " * 700, "needle in the middle " * 3 + "pad " * 600, "other " * 700])
    engine = Engine(spark, str(tmp_path / "wh"), None, vectors.HashedWords)
    engine.refresh(frame(spark, {"docs/long.md": long, "docs/b.md": "nothing here"}))
    hits = {r.path: r.snippet for r in engine.search("-zzz needles", "docs", 5).collect()}
    assert hits == {} or all("needle" not in v or k == "docs/long.md" for k, v in hits.items())
    near = engine.search("pad", "docs", 5).first()
    assert near.path == "docs/long.md" and "pad" in near.snippet
    alone = {r.path: r.snippet for r in engine.search("middle basename:zzz", "docs", 5).collect()}
    assert "docs/b.md" in alone and alone["docs/b.md"] == "nothing here"


def test_model_folder(spark, tmp_path):
    assert vectors.find_model("", str(tmp_path)) is None
    folder = tmp_path / "model"
    folder.mkdir()
    (folder / "tokenizer.json").write_text("{}")
    assert Engine(spark, str(tmp_path / "wh"), model_folders=(str(folder),)).provider is None
    (folder / "model_quantized.onnx").write_bytes(b"")
    engine = Engine(spark, str(tmp_path / "wh"), model_folders=(str(tmp_path), str(folder)))
    assert engine.provider.func is vectors.OnnxEncoder and engine.provider.args == (str(folder),)


def test_long_paths_and_rings(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(66)], "src int, dst int").coalesce(1)
    assert [r.node for r in graph.shortest_path(chain, 0, 66).collect()] == list(range(67))
    assert graph.shortest_path(chain, 0, 66, max_depth=5).count() == 0
    ring = spark.createDataFrame([(k, (k + 1) % 11) for k in range(11)] + [(20, 0), (5, 30), (30, 31)], "src int, dst int")
    assert [r.cycle for r in graph.cycles(ring).collect()] == [list(range(11))]
    assert graph.cycles(ring, 8).count() == 0 and graph.cycles(chain.where('src < 4')).count() == 0


def test_ignore_files_of_the_user_and_of_folders_above(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("HOME", str(tmp_path))
    for name, text in {"config/git/ignore": "*.tmp.py\n", "repo/.gitignore": "gone.py\n/proj/no/\n", "repo/.git/info/exclude": "local.py\n",
                       "repo/proj/.gitignore": "!back.py\n", "repo/proj/.ignore": "", "repo/proj/a.py": "", "repo/proj/x.tmp.py": "", "repo/proj/gone.py": "",
                       "repo/proj/no/b.py": "", "repo/proj/sub/no/c.py": "", "repo/proj/local.py": "", "repo/proj/back.py": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = {f"{base}/{x}" if base else x for base, names in folders(str(tmp_path / "repo/proj")) for x in names}
    assert found == {"a.py", "back.py", "sub/no/c.py"}


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/lib.rs": "mod x;", "src/_priv.py": "a", "data.bin": "z", "node_modules/x.js": "no", ".hidden.py": "no", "build/o.py": "no",
        ".gitignore": "*.log.txt\n/gen/\n!keep.log.txt\n", "a.log.txt": "no", "keep.log.txt": "yes", "gen/g.py": "no", "sub/gen/g.py": "yes", "README.md": "# t",
    }
    for name, text in files.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "tree/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "tree/big.py").write_bytes(b"#" * (1 << 20))
    (tmp_path / "tree/bigger.py").write_bytes(b"#" * ((1 << 20) + 1))
    return tmp_path / "tree"


def test_source_tree(spark, tree):
    rows = {r.relative_path: r for r in scan(spark, str(tree)).collect()}
    assert set(rows) == {"src/lib.rs", "src/_priv.py", "keep.log.txt", "sub/gen/g.py", "README.md", "big.py"}
    assert not rows["README.md"].is_code and rows["src/lib.rs"].extension == "rs"
    assert read_file(str(tree), "gen/g.py") and read_file(str(tree), "bad.py") is None and read_file(str(tree), "nope.py") is None
    assert IgnoreRules().extended("", "a/**/b").ignored("a/x/y/b", False)


def test_bursts_on_batch_and_stream_agree(spark, tmp_path):
    events = [("2024-01-01T00:00:00.000Z", "r", "a.py"), ("2024-01-01T00:00:00.100Z", "r", "b.py"), ("2024-01-01T00:00:00.200Z", "r", "target/x.py"),
              ("2024-01-01T00:00:05.000Z", "r", "a.py"), ("2024-01-01T00:01:00.000Z", "r", "z.py")]
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps({"ts": t, "root": r, "path": p, "kind": "modify"}) for t, r, p in events))
    batch = watch.quiet_batches(spark.read.schema(FS_EVENTS).json(str(folder)))
    want = {(str(r.begin), tuple(r.paths)) for r in batch.collect()}
    assert len(want) == 3 and ("a.py", "b.py") in {p for _, p in want}
    stream = watch.quiet_batches(watch.read_events(spark, str(folder), FS_EVENTS), delay="1 seconds")
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(str(r.begin), tuple(r.paths)) for r in spark.sql("select * from bursts").collect()}
    assert got <= want and len(got) == 2  # the last burst is still open


def test_stream_maintains_the_index(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "wh"), str(tree))
    engine.ensure()
    before = engine.status().first().documents
    (tree / "src/new.py").write_text("import lib")
    (tree / "README.md").unlink()
    batch = spark.createDataFrame([(["src/new.py", "README.md", "gone.py"],)], "paths array<string>")
    watch.apply_batch(engine, str(tree))(batch, 0)
    paths = {r.relative_path for r in engine.warehouse.read("files").collect()}
    assert "src/new.py" in paths and "README.md" not in paths and len(paths) == before
    assert engine.warehouse.read("manifest").where(F.col("relative_path") == "README.md").isEmpty()
