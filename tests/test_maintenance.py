"""Edges that follow changes of files, and commits of two writers."""

import random

import pytest

from lodestone.operators import imports, resolve
from lodestone.plans.engine import Engine
from lodestone.sources.warehouse import SupersededError, Warehouse


def frame(spark, project):
    rows = [(p, c, p.rpartition(".")[2], not p.endswith(".md"), str(hash(c))) for p, c in project.items()]
    return spark.createDataFrame(rows, "relative_path string, content string, extension string, is_code boolean, content_hash string")


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "relative_path string")


def edges_of(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


def last_segment(engine, name):
    return engine.spark.read.parquet(f"{engine.warehouse.folder}/{engine.warehouse.state()['tables'][name][-1][1]}")


def random_file(rng, project):
    """A path of one project and a text that tries other paths of it, of which some are not there."""
    k = rng.randrange(6)
    kind = rng.choice(("js", "ts", "py", "go", "php"))
    if kind == "go":
        return f"{project}/d{k}/{rng.choice('ab')}.go", f'import "x/{project}/d{rng.randrange(6)}"\nimport "{project}/d{rng.randrange(6)}" // {rng.random()}'
    other = rng.randrange(6)
    text = {
        "js": f"import a from './f{other}'; require('./f{rng.randrange(6)}.ts')", "ts": f"import './f{other}'\nexport * from './g/f{k}'",
        "py": f"from . import f{other}\nfrom .f{other} import y\nimport {project}.f{rng.randrange(6)}", "php": f"<?php require './f{other}.php';\nuse {project}\\f{rng.randrange(6)};",
    }[kind]
    return f"{project}/f{k}.{kind}", f"{text}\n// {rng.randrange(3)}" if kind != "py" else text


def test_edges_equal_a_full_rebuild_over_random_changes(spark, tmp_path):
    """200 projects in one tree, each with its own sequence of changes; after every commit all edges are those of a rebuild."""
    rng = random.Random(11)
    engine, files = Engine(spark, str(tmp_path / "wh")), {}
    seen = 0
    for step in range(4):
        changed, gone = {}, []
        for k in range(200):
            project = f"p{k}"
            own = [p for p in files if p.startswith(project + "/")]
            for _ in range(rng.randrange(1, 4) + 3 * (step == 0)):
                path, text = random_file(rng, project)
                changed[path] = text
            if own and rng.random() < 0.6:
                gone.append(rng.choice(own))
        for p in gone:
            changed.pop(p, None)
            files.pop(p)
        files |= changed
        engine.apply(frame(spark, changed), paths(spark, gone))
        want = frame(spark, files)
        full = edges_of(resolve.edges(want, imports.extract_imports(want)))
        assert edges_of(engine.warehouse.read("edges")) == full, step
        seen += len(full)
        if step:
            assert last_segment(engine, "edges").count() < len(full)
    assert seen > 800


def test_upsert_writes_its_own_edges_and_those_of_its_importers(spark, tmp_path):
    project = {f"src/m{k}.js": f"import './m{(k + 1) % 40}'\nimport './late{k % 10}'" for k in range(40)}
    engine = Engine(spark, str(tmp_path / "wh"))
    engine.refresh(frame(spark, project))
    assert engine.warehouse.read("edges").count() == 40
    none = paths(spark, [])
    engine.apply(frame(spark, {"src/m3.js": "import './m9'"}), none)
    assert edges_of(last_segment(engine, "edges")) == [("src/m3.js", "src/m9.js")]
    engine.apply(frame(spark, {"src/late7.js": "export default 1"}), none)  # four files try it
    woken = {f"src/m{k}.js" for k in (7, 17, 27, 37)}
    assert {r.src for r in last_segment(engine, "edges").collect()} == woken
    assert engine.warehouse.read("edges").where("dst = 'src/late7.js'").count() == 4
    engine.apply(frame(spark, {}), paths(spark, ["src/late7.js"]))
    assert {r.src for r in last_segment(engine, "edges").collect()} == woken
    assert engine.warehouse.read("edges").where("dst = 'src/late7.js'").count() == 0 and engine.warehouse.read("edges").count() == 40
    state = engine.warehouse.state()
    state["tables"].pop("tries")
    assert engine.warehouse._publish(state["version"], state)  # a warehouse from before that table
    engine.apply(frame(spark, {"src/late2.js": ""}), none)
    assert engine.warehouse.read("edges").where("dst = 'src/late2.js'").count() == 4
    assert engine.warehouse.read("tries").where("candidate = 'src/late5.ts'").count() == 4


def test_no_commit_is_lost_whatever_comes_between(spark, tmp_path, monkeypatch):
    """Another writer commits while the first has written its draft, or is about to take its number."""
    first, second = Warehouse(spark, str(tmp_path / "wh")), Warehouse(spark, str(tmp_path / "wh"))
    rows = lambda x: spark.createDataFrame([(x, "h")], "relative_path string, content_hash string")
    claim = Warehouse._claim
    began = []

    def late(self, draft, version):
        if self is first and not began:
            began.append(version)
            assert second.state()["version"] == version - 1  # a draft is no version
            second.commit(version - 1, {"manifest": rows(f"second-{version}")})
        return claim(self, draft, version)

    monkeypatch.setattr(Warehouse, "_claim", late)
    for version in (1, 2):
        began.clear()
        with pytest.raises(SupersededError):
            first.commit(version - 1, {"manifest": rows("first")})
        assert first.state()["version"] == version
    assert {r[0] for r in first.read("manifest").select("relative_path").collect()} == {"second-1", "second-2"}
    assert not [p for p in (tmp_path / "wh/versions").iterdir() if p.name.endswith(".draft")]
    began.append(0)
    assert first.commit(2, {"manifest": rows("first")}) == 3 and second.read("manifest").count() == 3


def test_many_names_in_small_files_are_not_broadcast(spark, tmp_path):
    """60000 names make a file far below Spark's threshold, and are not sent through the driver; few names are."""
    from pyspark.sql import functions as F

    from lodestone.operators import incremental
    from lodestone.runtime import Scratch

    scratch = Scratch(spark, "names")
    path = F.concat(F.lit("m/d"), F.col("id").cast("string"), F.lit(".ts")).alias("relative_path")
    for n, how in ((60_000, 0), (100, 1)):
        changes = scratch.table(spark.range(n).select(path, F.lit("added").alias("change")), f"changes-{n}")
        files = scratch.table(spark.range(70_000).select(path, F.col("id").alias("content")), f"files-{n}")
        for got in (incremental.changed_files(files, changes), incremental.replace_rows(files, files.limit(0), changes), resolve.woken_importers(files.withColumn("candidate", F.col("relative_path")), changes)):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert plan.count("BroadcastExchange") == how
    house = Warehouse(spark, str(tmp_path / "wh"))
    house.commit(0, {"manifest": spark.range(70_000).select(path, F.lit("h").alias("content_hash"))})
    house.commit(1, {}, spark.range(60_000).select(path))
    left = house.read("manifest")
    assert left.count() == 10_000 and ("BroadcastExchange" in left._jdf.queryExecution().executedPlan().toString()) == (house._fs.getContentSummary(house._path(f"{house.folder}/{house.state()['stale'][0][1]}")).getLength() <= 256 << 10)
    scratch.drop()
