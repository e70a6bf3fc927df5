"""The model on small databases: gradients, training, evaluation, combinations of entities, questions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.labels import LabelTransform
from kinfold.plans import blocks as B
from kinfold.plans import kernels as K
from kinfold.plans import model as M
from kinfold.plans.ask import Registry, Session, decode, read_env, schema_json, unfenced
from kinfold.plans.model import Config, prepare, train
from kinfold.plans.task import TaskSpec, build_split
from kinfold.schema import Database, ForeignKey, LogicalType, Table
from kinfold.streaming.scoring import windowed

N, C = LogicalType.NUMERICAL, LogicalType.CATEGORICAL


@pytest.fixture(scope="module")
def db(spark):
    """Loans between two members each, of a book or of none; one book and one member have no loan."""
    rows = [(11, 0.4, "desk", 1, 2, 5, 0.0), (12, -1.5, "post", 2, 1, 5, 1.0), (13, 0.9, "desk", 1, 3, None, 1.0), (14, 0.1, "app", 3, 3, 6, 0.0), (15, -0.2, "post", 2, 9, 6, 1.0)]
    loans = spark.createDataFrame(rows, "id long, weeks double, channel string, giver long, taker long, book_id long, late double")
    members = spark.createDataFrame([(1, 0.3), (2, -0.9), (3, 1.4), (4, 0.0)], "id long, age double")
    books = spark.createDataFrame([(5, "x", 2.0), (6, "y", -1.0), (7, "x", 0.5)], "id long, shelf string, weight double")
    out = Database()
    fks = (ForeignKey("giver", "members"), ForeignKey("taker", "members"), ForeignKey("book_id", "books"))
    out.add_table(Table("loans", loans, {"id": N, "weeks": N, "channel": C, "giver": N, "taker": N, "book_id": N, "late": N}, "id", None, fks))
    out.add_table(Table("members", members, {"id": N, "age": N}, "id"))
    out.add_table(Table("books", books, {"id": N, "shelf": C, "weight": N}, "id"))
    return out


def without_takers(db):
    """The database with fewer edge types."""
    loans, out = db.get_table("loans"), Database()
    out.add_table(Table("loans", loans.df, loans.types | {"taker": LogicalType.TEXT}, "id", None, tuple(k for k in loans.fks if k.column != "taker")))
    out.add_table(db.get_table("members"))
    out.add_table(db.get_table("books"))
    return out


SPEC = TaskSpec("loans", "late", label_transform=LabelTransform("threshold", 0.5))
SMALL = Config(channels=4, hidden=4, layers=1, dropout=0.0, epochs=2, lr=0.01, exclude_fk=True)


def plain(model, p, samples, scale):
    """(loss, logits of the samples) without Spark: full passes over all nodes. scale: of each sample's loss."""
    raw = {t: {r["_nid"]: np.array(r["x"]) for r in df.collect()} for t, df in model.raw.items()}
    edges = {e: [(r["src"], r["dst"]) for r in df.collect()] for e, df in model.graph.edges.items()}
    c, last = model.config.channels, model.config.layers - 1

    def value(p):
        h = {t: K.linear(p, f"enc.{t}", np.stack([x[i] for i in sorted(x)])) for t, x in raw.items()}
        for layer in range(last + 1):
            new = {}
            for t in h:
                means = {}
                for e in model.incoming(t):
                    rows = [[h[e.src][s] for s, d in edges[e] if d == i] for i in range(len(h[t]))]
                    means[e.name] = np.stack([np.mean(r, axis=0) if r else np.zeros(c) for r in rows])
                new[t] = K.sage(p, layer, t, h[t], means, layer < last)
            h = new
        at, y = [i for i, _ in samples], np.array([y for _, y in samples])
        logits = K.head(p, h["loans"][at])[0]
        each = [K.loss(model.spec.task_type, logits[i : i + 1], y[i : i + 1], len(y), model.pos_weight, model.weights)[0] for i in range(len(y))]
        return float((np.array(each) * scale).sum()), logits, h

    return value if p is None else value(p)


@pytest.mark.parametrize(("layers", "local"), [(1, 0), (2, 0), (2, 1 << 20), (3, 1 << 20), (3, 0)])
def test_gradients_match_differences(spark, db, layers, local):
    if layers == 3:  # a smaller graph
        full, db = db, Database()
        loans = full.get_table("loans")
        hidden = dict.fromkeys(("giver", "taker"), LogicalType.TEXT)
        db.add_table(Table("loans", loans.df, loans.types | hidden, "id", None, (ForeignKey("book_id", "books"),)))
        db.add_table(full.get_table("books"))
    model = prepare(db, SPEC, Config(channels=3, hidden=3, layers=layers, dropout=0.0, exclude_fk=True, seed=layers, local_bytes=local))
    assert model.encoders["loans"].width == 4 and model.encoders["books"].width == 3
    rows = [(0, 0.0), (1, 1.0), (3, 0.0), (4, 1.0)]
    samples = spark.createDataFrame([(i, y, "train") for i, y in rows] + [(2, 1.0, "val")], "_nid long, label double, split string")
    rng = np.random.default_rng(1)  # away from the kinks at zero
    model.params = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in model.params.items()}
    model.pos_weight = 1.5
    value = plain(model, None, rows, np.ones(4))
    inputs = model.inputs(samples)
    assert set(inputs.local) == (set() if layers == 1 or not local else {"books"} if layers == 3 else {"books", "members"})
    loss, grads, scores = model.step(model.params, inputs, 4, 0)
    expected, _, h = value(model.params)
    assert loss == pytest.approx(expected, abs=1e-12)
    assert scores.shape == (1, 3) and scores[0, 0] == 2 and scores[0, 1] == pytest.approx(1 / (1 + np.exp(-K.head(model.params, h["loans"][2:3])[0][0, 0])), abs=1e-12)
    assert {r["_nid"]: r["score"] for r in model.scores().collect()}[2] == pytest.approx(scores[0, 1], abs=1e-12)
    # Parameters of the last layer for other types than the target's never matter.
    assert set(model.params) - set(grads) == {k for k in model.params if k.startswith(f"l{layers - 1}.") and (k.startswith((f"l{layers - 1}.self.", f"l{layers - 1}.bias.")) and ".loans" not in k or ".neigh." in k and "__loans." not in k)}
    for name, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: 1 if layers < 3 else 3]:
            p = {k: v.copy() for k, v in model.params.items()}
            p[name][at] += 1e-6
            up = value(p)[0]
            p[name][at] -= 2e-6
            assert g[at] == pytest.approx((up - value(p)[0]) / 2e-6, abs=1e-5), name
    inputs.release()


def test_batches_add_up_their_own_means(spark, db):
    model = prepare(db, SPEC, SMALL)
    rows = [(i, float(i % 2)) for i in range(5)]
    samples = spark.createDataFrame([(i, y, "train") for i, y in rows], "_nid long, label double, split string")
    scales = {r["_nid"]: r["scale"] for r in M.batched(samples, 2).collect()}
    assert scales == {0: 2.5, 1: 2.5, 2: 2.5, 3: 2.5, 4: 5.0}
    _, grads, _ = model.step(model.params, model.inputs(M.batched(samples, 2)), 5, 0)
    value = plain(model, None, rows, np.array([scales[i] for i, _ in rows]))
    for name in ("enc.members.W", "head.2.W", "l0.self.loans.W"):
        p = {k: v.copy() for k, v in model.params.items()}
        p[name][0, 0] += 1e-6
        assert grads[name][0, 0] == pytest.approx((value(p)[0] - value(model.params)[0]) / 1e-6, abs=1e-4)


def test_merged_sums_are_the_same(spark, db, monkeypatch):
    model = prepare(db, SPEC, SMALL)
    samples = spark.createDataFrame([(i, float(i % 2), "val" if i == 4 else "train") for i in range(5)], "_nid long, label double, split string").repartition(3)
    inputs = model.inputs(samples)
    one = model.step(model.params, inputs, 4, 0)
    monkeypatch.setattr(M, "DIRECT", 1)
    other = model.step(model.params, inputs, 4, 0)
    assert one[0] == pytest.approx(other[0], abs=1e-12) and (one[2] == other[2]).all()
    assert all(np.allclose(one[1][k], other[1][k], atol=1e-12) for k in one[1])


def test_adam():
    adam, p = K.Adam(0.1), {"w": np.array([1.0, -2.0])}
    m = v = np.zeros(2)
    w = p["w"].copy()
    for t in range(1, 4):
        g = np.array([0.5, -0.1]) * t
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        adam.step(p, {"w": g})
        assert np.allclose(p["w"], w, atol=1e-15)


@pytest.mark.parametrize("task", ["binary_classification", "regression", "multiclass_classification"])
def test_metrics_at_the_driver_are_those_of_queries(spark, task):
    from kinfold.functions import metrics

    rng = np.random.default_rng(4)
    ids, y = np.arange(300.0), rng.integers(0, 2 if task[0] == "b" else 4, 300).astype(float)
    score = rng.integers(0, 3, 300).astype(float) if task[0] == "m" else np.round(rng.random(300), 1)
    got = K.metrics(task, ids, score, y, 4)
    rows = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(ids, score, y)], "_nid long, score double, label double").repartition(3)
    if task[0] == "b":
        expected = metrics.binary(rows, "score", "label").first().asDict() | metrics.ranking(rows, "score", "label", "_nid").first().asDict()
    else:
        expected = (metrics.regression(rows, "score", "label") if task[0] == "r" else metrics.multiclass(rows, "score", "label", 4)).first().asDict()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)
    for k, v in K.metrics(task, np.zeros(0), np.zeros(0), np.zeros(0), 4).items():
        assert v == (0.5 if k == "auc" else 0.0)


def test_combinations_of_entities(spark, db):
    model = prepare(db, SPEC, Config(channels=3, hidden=3, layers=2, dropout=0.0, exclude_fk=True))
    h = plain(model, model.params, [(0, 0.0)], np.ones(1))[2]
    score = lambda *v: float(1 / (1 + np.exp(-K.head(model.params, np.mean(v, axis=0)[None])[0][0, 0])))
    # Two foreign keys into one table, by column; keys are text in a reply.
    assert model.synthesize({"giver": "3", "taker": "1", "book_id": 7}) == pytest.approx(score(h["members"][2], h["members"][0], h["books"][2]), abs=1e-12)
    assert model.synthesize({"members": 4, "no_such": 1, "book_id": "99"}) == pytest.approx(score(h["members"][3]), abs=1e-12)
    for none in ({}, {"book_id": "99"}):
        with pytest.raises(ValueError):
            model.synthesize(none)
    model.release()


def test_pairs_of_entities(spark, db):
    full, db = db, Database()
    loans = full.get_table("loans")
    db.add_table(Table("loans", loans.df, loans.types | {"book_id": LogicalType.TEXT}, "id", None, tuple(k for k in loans.fks if k.column != "book_id")))
    db.add_table(full.get_table("members"))
    model = prepare(db, SPEC, Config(channels=3, hidden=3, layers=2, dropout=0.0, exclude_fk=True))
    h = plain(model, model.params, [(0, 0.0)], np.ones(1))[2]
    score = lambda *v: float(1 / (1 + np.exp(-K.head(model.params, np.mean(v, axis=0)[None])[0][0, 0])))
    asked = spark.createDataFrame([(1, 2), (4, 1), (4, 1), (77, 2)], "giver long, taker long")
    found = model.pair_scores(asked, ["giver", "taker"]).collect()
    out = {(r["giver"], r["taker"]): (r["prediction"], r["source"]) for r in found}
    row = {(r["giver"], r["taker"]): r["prediction"] for r in model.predict().collect()}
    assert out[1, 2] == (pytest.approx(row[1, 2], abs=1e-12), "row") and out[4, 1] == (pytest.approx(score(h["members"][3], h["members"][0]), abs=1e-12), "entities")
    assert out[77, 2][1] == "entities" and out[77, 2][0] == pytest.approx(score(h["members"][1]), abs=1e-12) and len(found) == 4
    model.release()


def test_layer_with_relu():
    rng = np.random.default_rng(2)
    p = {"l0.self.a.W": rng.normal(size=(3, 3)), "l0.self.a.b": rng.normal(size=3), "l0.bias.a": rng.normal(size=3), "l0.neigh.e.W": rng.normal(size=(3, 3)), "l0.neigh.e.b": rng.normal(size=3)}
    own, mean, up = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    value = lambda q, o, m: float((K.sage(q, 0, "a", o, {"e": m}, True) * up).sum())
    g_own, g_mean, grads = K.sage_back(p, 0, "a", own, {"e": mean}, K.sage(p, 0, "a", own, {"e": mean}, True), up, True)
    for name, g in grads.items():
        for at in np.ndindex(g.shape):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += 1e-6
            assert g[at] == pytest.approx((value(q, own, mean) - value(p, own, mean)) / 1e-6, abs=1e-4)
    for x, g, at in ((own, g_own, 0), (mean, g_mean["e"], 1)):
        d = x.copy()
        d[2, 1] += 1e-6
        assert g[2, 1] == pytest.approx((value(p, *((d, mean) if at == 0 else (own, d))) - value(p, own, mean)) / 1e-6, abs=1e-4)


def test_heads():
    x = np.array([[0.2, -0.1, 0.5], [1.0, 0.0, -1.0]])
    for task, y in (("multiclass_classification", np.array([2.0, 0.0])), ("regression", np.array([0.3, 0.1]))):
        value, g = K.loss(task, x if task[0] == "m" else x[:, :1], y, 2)
        d = x.copy()
        d[0, 0] += 1e-6
        assert g[0, 0] == pytest.approx((K.loss(task, d if task[0] == "m" else d[:, :1], y, 2)[0] - value) / 1e-6, abs=1e-5)
    mask = K.drop_mask(np.arange(1000), 16, 0.25, 3)
    assert mask.mean() == pytest.approx(1.0, abs=0.05) and set(np.unique(mask)) == {0.0, 1 / 0.75}


def test_train_predict_save_ask(spark, db, tmp_path):
    big = Database()
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 7).cast("double").alias("weeks"), F.when(F.col("id") % 2 == 0, "desk").otherwise("post").alias("channel"), (F.col("id") % 2 + 5).alias("book_id"), (F.col("id") % 2).cast("double").alias("late"))
    big.add_table(Table("loans", rows, {"id": N, "weeks": N, "channel": C, "book_id": N, "late": N}, "id", None, (ForeignKey("book_id", "books"),)))
    big.add_table(db.get_table("books"))
    reply = json.dumps({"target_table": "loans", "target_column": "late", "task_type": "binary_classification", "label_transform": {"kind": "threshold", "threshold": 0.5}, "inference_filters": [{"column": "channel", "op": "=", "value": "post"}], "inference_agg": "mean"})
    said = []

    def speaker(system, message):
        said.append(message)
        return f"```json\n{reply}\n```" if "JSON" in system else message

    config = Config(channels=4, hidden=4, layers=2, dropout=0.0, epochs=3, lr=0.05, evaluate_every=2)
    session = Session(spark, big, speaker, config, Registry(tmp_path))
    spec = decode(reply, big)
    assert session.intent(spec) == "train"
    answer = session.ask("how late are loans by post?")
    assert "mean over 30 rows" in answer and session.intent(spec) == "infer"
    history = session.models[spec.fingerprint()].history
    losses = [h["loss"] for h in history if "loss" in h]
    assert len(losses) == 3 and losses[-1] < losses[0] and ["auc" in h for h in history[:3]] == [True, False, True] and "auc" in history[3]["test"]
    model = session.models[spec.fingerprint()]
    loans = model.db.get_table("loans")
    rows = build_split(loans, model.spec, "id")[0].join(loans.df.select("id", "_nid"), "id")
    assert model.evaluate(rows.where("split = 'test'").select("_nid", "label")) == pytest.approx(history[3]["test"], abs=1e-9)
    again = Session(spark, big, speaker, config, Registry(tmp_path))
    assert again.intent(spec) == "load"
    assert 0 <= again.model(spec).synthesize({"books": 5, "loans": 3}) <= 1
    assert again.models[spec.fingerprint()].predict().count() == 60


def test_judging_by_query_is_the_same(spark, db, monkeypatch):
    rows = spark.range(50).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(11))).cast("double").alias("weeks"), (F.col("id") % 2 + 5).alias("book_id"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2))).cast("double").alias("late"))
    two = Database()
    two.add_table(Table("loans", rows, {"id": N, "weeks": N, "book_id": N, "late": N}, "id", None, (ForeignKey("book_id", "books"),)))
    two.add_table(db.get_table("books"))
    histories = []
    for most in (M.COLLECTED, 0):
        monkeypatch.setattr(M, "COLLECTED", most)
        histories.append(train(spark, SPEC, two, Config(channels=3, hidden=3, layers=1, epochs=2)).history)
    for a, b in zip(*histories, strict=True):
        assert a.get("test", a) == pytest.approx(b.get("test", b), abs=1e-9)


def test_large_sets_are_scored_with_the_gradients(spark, db, monkeypatch):
    """Beyond COLLECTED rows too, a pass gives scores and gradients, and the prediction reads what the training stored."""
    passes, stored, score, make = [], [], M.Model.scores, M.Model.inputs
    monkeypatch.setattr(M, "COLLECTED", 0)
    monkeypatch.setattr(M.Model, "scores", lambda self, *a, **k: passes.append(1) or score(self, *a, **k))
    monkeypatch.setattr(M.Model, "inputs", lambda self, *a, **k: stored.append(1) or make(self, *a, **k))
    rows = spark.range(50).select(F.col("id"), (F.col("id") % 11).cast("double").alias("weeks"), (F.col("id") % 2 + 5).alias("book_id"), (F.col("id") % 3 % 2).cast("double").alias("late"))
    two = Database()
    two.add_table(Table("loans", rows, {"id": N, "weeks": N, "book_id": N, "late": N}, "id", None, (ForeignKey("book_id", "books"),)))
    two.add_table(db.get_table("books"))
    model = train(spark, SPEC, two, Config(channels=3, hidden=3, layers=1, epochs=2))
    assert not passes and {"auc", "f1"} <= set(model.history[-1]["test"])
    assert model.predict().count() == 50 and len(passes) == len(stored) == 1
    model.release()
    assert model.ready is None and model.predict().count() == 50 and len(stored) == 2


def test_replies(spark, db):
    assert unfenced("x\n```json\n{}\n```\ny").strip() == "{}"
    good = {"target_table": "loans", "target_column": "late", "task_type": "regression", "label_transform": {"kind": "identity"}}
    assert decode(json.dumps(good), db).label_transform.kind == "normalize"
    for bad in ({"target_table": "no"}, {"target_column": "no"}, {"task_type": "no"}, {"label_transform": {"kind": "no"}}, {"inference_filters": [{"column": "late"}]}):
        with pytest.raises(ValueError):
            decode(json.dumps(good | bad), db)
    with pytest.raises(ValueError):
        decode("not json", db)
    assert json.loads(schema_json(db))[0]["foreign_keys"][2] == {"column": "book_id", "references": "books"}
    assert read_env("# no\nexport A='1'\nB = 2\n") == {"A": "1", "B": "2"}


def test_client_keeps_what_was_said(tmp_path, monkeypatch):
    from kinfold.plans.client import Client, setting

    for name in ("KINFOLD_API_KEY", "KINFOLD_MODEL", "KINFOLD_SYSTEM"):
        monkeypatch.delenv(name, raising=False)
    sent, replies = [], [{"content": [{"text": "one"}], "usage": {"input_tokens": 3, "output_tokens": 1}}, {"error": {"message": "busy"}}, {"content": []}, None]

    def transport(url, headers, body):
        sent.append((url, headers, json.loads(body)))
        reply = replies[len(sent) - 1]
        return json.dumps(reply).encode() if reply else b"oops"

    client = Client("https://example.org/messages", env_file=tmp_path / ".env", transport=transport)
    with pytest.raises(RuntimeError, match="no key"):
        client.send("hi")
    (tmp_path / ".env").write_text("# settings\nexport KINFOLD_API_KEY='k1'\nKINFOLD_MODEL=m\n")
    monkeypatch.setenv("KINFOLD_MODEL", "other")
    assert setting("KINFOLD_MODEL", tmp_path / ".env") == "other" and setting("NOPE", tmp_path / ".env") is None
    assert client.send("first") == "one" and client.usage == {"input_tokens": 3, "output_tokens": 1}
    assert sent[0][1]["x-api-key"] == "k1" and sent[0][2] == {"model": "other", "max_tokens": 1024, "messages": [{"role": "user", "content": "first"}]}
    with pytest.raises(RuntimeError, match="busy"):
        client.send("second")
    assert client("rules", "alone") == "" and sent[2][2]["system"] == "rules" and len(sent[2][2]["messages"]) == 1
    assert [m["content"] for m in client.history] == ["first", "one"]
    with pytest.raises(RuntimeError, match="not JSON"):
        client.send("third")
    assert [m["content"] for m in sent[3][2]["messages"]] == ["first", "one", "third"]
    client.reset()
    assert client.history == []


def test_train_on_a_query(spark):
    spark.range(40).select(F.col("id").alias("shopId"), (F.col("id") % 3).cast("double").alias("size")).where("shopId < 6").write.mode("overwrite").saveAsTable("shops")
    try:
        query = "SELECT id AS saleId, id % 6 AS shopId, CAST(id % 5 AS DOUBLE) AS amount, rand() AS noise FROM range(60)"
        spec = TaskSpec("", "amount", "regression", LabelTransform("normalize"))
        model = M.train_sql(spark, "sales", query, spec, tables=["shops"], config=Config(channels=4, hidden=4, layers=1, epochs=2, batch_size=16))
        assert {e.name for e in model.graph.edges} == {"sales__shopId__shops", "shops__rev_shopId__sales"}
        assert spark.table("sales").agg(F.sum("noise")).first() == spark.table("sales").agg(F.sum("noise")).first() and model.predict().count() == 60
        assert M.report(model.history).splitlines()[0].startswith("    1    loss ") and M.report(model.history).splitlines()[-1].startswith("test     rmse_norm ")
    finally:
        spark.sql("DROP TABLE IF EXISTS shops")
        spark.sql("DROP TABLE IF EXISTS sales")


def test_windows(spark):
    rows = spark.range(20).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") / 20.0).alias("prediction"))
    out = windowed(rows, "ts", []).orderBy("start").collect()
    assert [r["n_rows"] for r in out] == [10, 10] and out[1]["fraction"] == 1.0


def dense_of(model, p):
    """Parameters of a model with sparse features, as those of one that writes all of them out."""
    out = {k: v for k, v in p.items() if not k.endswith(".E")}
    for t, e in model.encoders.items():
        columns, at, first = [], 0, 0
        for _, kind, args in e.parts:
            n = args[0] if kind == "many" else {"num": 1, "time": 5}.get(kind, len(args))
            if kind == "many":
                columns.append(p[f"enc.{t}.E"][first : first + n].T)
                first += n
            else:
                columns.append(p[f"enc.{t}.W"][:, at : at + n])
                at += n
        out[f"enc.{t}.W"] = np.hstack(columns)
    return out


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_sparse_features_are_one_hot_vectors(spark, db, local):
    db, layers = without_takers(db), 2
    rows = [(i, y, s) for i, y, s in zip(range(5), (0.0, 1.0, 1.0, 0.0, 1.0), ("train", "train", "val", "train", "train"))]
    samples = spark.createDataFrame(rows, "_nid long, label double, split string")
    few = prepare(db, SPEC, Config(channels=3, hidden=3, layers=layers, dropout=0.0, exclude_fk=True, local_bytes=local, vocabulary=1))
    full = prepare(db, SPEC, Config(channels=3, hidden=3, layers=layers, dropout=0.0, exclude_fk=True, local_bytes=local))
    assert (few.encoders["loans"].many, few.encoders["books"].many, full.encoders["loans"].many) == (3, 2, 0) and few.encoders["loans"].width == 1
    full.params = dense_of(few, few.params)
    assert {k: v.shape for k, v in full.params.items()} == {k: v.shape for k, v in prepare(db, SPEC, full.config).params.items()}
    a, b = (m.step(m.params, m.inputs(samples), 4, 0) for m in (few, full))
    got = dense_of(few, {k: g.full(few.params[k].shape) if isinstance(g, K.Rowwise) else g for k, g in a[1].items()})
    assert a[0] == pytest.approx(b[0], abs=1e-12) and got.keys() == b[1].keys()
    for k, g in b[1].items():
        assert np.allclose(got[k], g, atol=1e-12), k
    scores = [{r["_nid"]: r["score"] for r in m.scores().collect()} for m in (few, full)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-12)
    K.Adam(0.1).step(few.params, a[1])
    K.Adam(0.1).step(full.params, b[1])
    assert all(np.allclose(v, full.params[k], atol=1e-9) for k, v in dense_of(few, few.params).items())


def test_sparse_rows_survive_the_trip():
    rng = np.random.default_rng(3)
    lists = [[1.0, 2.0], None, [3.0, 4.0, 7.0, 0.5], [5.0, 6.0, 2.0, 1.0, 9.0, -1.0]]
    m = B.matrix(M.pa.array(lists, M.pa.list_(M.pa.float64())), 2)
    assert m.dense.tolist() == [[1, 2], [0, 0], [3, 4], [5, 6]] and list(zip(m.row.tolist(), m.column.tolist(), m.value.tolist())) == [(2, 7, 0.5), (3, 2, 1.0), (3, 9, -1.0)]
    assert B.lists(m).to_pylist() == [x or [0.0, 0.0] for x in lists] and B.lists(m[np.array([3, 0, 3])]).to_pylist() == [lists[3], lists[0], lists[3]]
    at = np.array([0, 0, 2, 2])
    s = B.summed(m, at, 3)
    assert s.dense.tolist() == [[1, 2], [0, 0], [8, 10]] and list(zip(s.row.tolist(), s.column.tolist(), s.value.tolist())) == [(2, 2, 1.0), (2, 7, 0.5), (2, 9, -1.0)]
    g = K.Rowwise(np.array([4, 1, 4]), rng.normal(size=(3, 2)))
    assert np.allclose((g + g).full((5, 2)), 2 * g.full((5, 2)))


def test_a_column_of_very_many_values(spark):
    n = 200_000
    rows = spark.range(n + 50_000).select(F.col("id"), F.concat(F.lit("value "), F.col("id") % n).alias("kind"), (F.col("id") % n % 2).cast("double").alias("odd"))
    db = Database()
    db.add_table(Table("things", rows, {"id": N, "kind": C, "odd": N}, "id"))
    spec = TaskSpec("things", "odd", label_transform=LabelTransform("threshold", 0.5))
    model = train(spark, spec, db, Config(channels=4, hidden=4, layers=1, dropout=0.0, epochs=1, lr=0.1))
    assert model.params["enc.things.E"].shape == (n, 4) and model.encoders["things"].many == n
    # One step moves rows of the values that the training rows hold (some have no gradient behind a ReLU), and of no others.
    samples, _ = build_split(model.db.get_table("things"), spec, "id")
    known = model.encoders["things"].values["kind"]
    seen = {r[0] for r in samples.where("split = 'train'").join(known, F.col("kind") == F.col("value")).select("index").distinct().collect()}
    fresh = K.init({"things": (1, n)}, [], "things", 4, 1, 4, 1)["enc.things.E"]
    moved = set(np.flatnonzero((model.params["enc.things.E"] != fresh).any(axis=1)).tolist())
    assert moved <= seen and len(moved) > 100_000


def test_a_hub_is_in_no_single_block(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 200)
    monkeypatch.setattr(B, "HUB", 50)
    n = 3000
    loans = spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("book_id"), (F.col("id") % 5).cast("double").alias("weeks"), (F.col("id") % 3 % 2).cast("double").alias("late"))
    books = spark.range(97).select("id", (F.col("id") / 50).alias("weight"))
    db = Database()
    db.add_table(Table("loans", loans, {"id": N, "book_id": N, "weeks": N, "late": N}, "id", None, (ForeignKey("book_id", "books"),)))
    db.add_table(Table("books", books, {"id": N, "weight": N}, "id"))
    samples = spark.range(n).select(F.col("id").alias("_nid"), (F.col("id") % 3 % 2).cast("double").alias("label"), F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"))
    found = {}
    for local in (0, 1 << 20):
        model = prepare(db, SPEC, Config(channels=3, hidden=3, layers=2, dropout=0.0, exclude_fk=True, local_bytes=local))
        inputs = model.inputs(samples)
        found[local] = model.step(model.params, inputs, 2700, 0)
        if not local:
            sizes = [r["count"] for r in inputs.rows["loans"].groupBy("part").count().collect()]
            assert len(sizes) == 15 and max(sizes) < 2 * B.BLOCK  # one book has 1,500 loans
            # The hub's vector goes to every block once, those of others to the block of their loans.
            routes = {r["_nid"]: len(r["routes"]) for r in inputs.rows["books"].collect()}
            assert routes[0] == 15 and max(v for k, v in routes.items() if k) == 1
            # And what comes for it is one sum from each block.
            sent = model.forward(model.params, inputs, {"loans"}, [], model._light(model.params, inputs))[1][0]
            assert sent.where("_nid = 0").count() == 15 and sent.count() == 15 + sum(1 for k, v in routes.items() if k and v)
        inputs.release()
        model.release()
    a, b = found[0], found[1 << 20]
    assert a[0] == pytest.approx(b[0], abs=1e-12) and all(np.allclose(g, b[1][k], atol=1e-12) for k, g in a[1].items())
    assert dict(zip(a[2][:, 0], a[2][:, 1])) == pytest.approx(dict(zip(b[2][:, 0], b[2][:, 1])), abs=1e-12)


def test_training_finds_what_the_neighbours_tell(spark):
    from kinfold.plans.queries import order_task

    db, spec = order_task(spark, "/root/testdata/sf0.001")
    histories = []
    for local in (0, 16 << 20):
        model = train(spark, spec, db, Config(channels=8, hidden=8, layers=2, epochs=6, lr=0.03, dropout=0.0, exclude_fk=True, local_bytes=local))
        histories.append(model.history[-1]["test"])
        model.release()
    assert histories[0] == pytest.approx(histories[1], abs=1e-6) and histories[0]["auc"] > 0.85


def test_a_lost_training_goes_on(spark, db, tmp_path, monkeypatch):
    rows = spark.range(60).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(11))).cast("double").alias("weeks"), F.concat(F.lit("c"), F.col("id") % 5).alias("channel"), (F.col("id") % 2).cast("double").alias("late"))
    one = Database()
    one.add_table(Table("loans", rows, {"id": N, "weeks": N, "channel": C, "late": N}, "id"))
    config = Config(channels=3, hidden=3, layers=1, epochs=4, lr=0.05, vocabulary=2)
    whole = train(spark, SPEC, one, config)
    path = f"file://{tmp_path}/state.npz"
    kept, step = M.replace(config, checkpoint=path), M.Model.step

    def lost(self, params, inputs, n, epoch, *args, **kwargs):
        if epoch == 2 and kwargs.get("learn", True):
            raise KeyboardInterrupt
        return step(self, params, inputs, n, epoch, *args, **kwargs)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(M.Model, "step", lost)
        train(spark, SPEC, one, kept)
    again = train(spark, SPEC, one, kept)
    for a, b in zip(whole.history, again.history, strict=True):
        assert a.get("test", a) == pytest.approx(b.get("test", b), abs=1e-9)
    assert all(np.allclose(v, again.params[k], atol=1e-9) for k, v in whole.params.items()) and len(again.seconds) == 4
    assert M.report(again.history, again.seconds).splitlines()[3].endswith(" s")
    with pytest.raises(ValueError, match="another training"):
        train(spark, SPEC, one, M.replace(kept, channels=4))
    # Where the writer was lost between removing the old state and putting the new one in place, the new one counts.
    (tmp_path / "state.npz").rename(tmp_path / "state.npz.part")
    assert M.read(spark, path) and M.read(spark, f"file://{tmp_path}/no.npz") is None


def test_weights_in_a_shared_store(spark, db, tmp_path):
    model = prepare(db, SPEC, SMALL)
    registry = Registry(f"file://{tmp_path}/models", spark)
    assert not registry.has(SPEC, SMALL)
    model.save(registry.path(SPEC, SMALL))
    assert registry.has(SPEC, SMALL)
    other = prepare(db, SPEC, M.replace(SMALL, seed=7))
    other.load(registry.path(SPEC, SMALL))
    assert all((v == other.params[k]).all() for k, v in model.params.items())
    registry.remove(SPEC, SMALL)
    assert not registry.has(SPEC, SMALL)
