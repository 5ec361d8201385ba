"""Registered queries do the operators' whole job: all sparse channels, the production settings, no cap on rows."""

from pyspark.sql import functions as F

from linkengine.operators import blocking, features, model
from linkengine.plans import pipeline, registry

SF = "/root/testdata/sf0.01"


def test_candidates_of_all_channels(spark):
    cands = registry._cands(spark, SF)[0]
    assert {f"{c.name}_score" for c in blocking.SPARSE} <= set(cands.columns)
    assert cands.agg(F.max("cheap_rank")).first()[0] >= 10


def test_union_of_all_channels(spark):
    assert {f"{c.name}_score" for c in blocking.SPARSE} <= set(registry._union(spark, SF).columns)


class Caught(Exception):
    pass


def caught(call):
    try:
        call()
    except Caught as e:
        return e.args
    raise AssertionError("not called")


def test_pre_ranker_settings(spark, monkeypatch):
    def pruner(union, truth, **params):
        raise Caught(union.where("cross_pair_score is not null").count(), params)

    monkeypatch.setattr(model, "train_pruner", pruner)
    found, params = caught(lambda: registry.queries()["pre_ranker"](spark, SF))
    assert found > 0 and params == {}


def test_stage_one_settings(spark, monkeypatch):
    def folds(df, names, **params):
        raise Caught(names, params)

    monkeypatch.setattr(registry, "_features", lambda s, d: s.createDataFrame([("a", "b")], "s1_id string, cand_id string"))
    monkeypatch.setattr(model, "out_of_fold", folds)
    assert caught(lambda: registry.queries()["stage1_oof"](spark, SF)) == (features.FEATURES, {})


def test_link_settings(spark, monkeypatch):
    def train(records, truth, settings=None):
        raise Caught(settings or pipeline.Settings())

    monkeypatch.setattr(pipeline, "train", train)
    assert caught(lambda: registry.queries()["link"](spark, SF)) == (pipeline.Settings(),)


def test_bootstrap_rounds(spark, monkeypatch):
    def diff(per_entity, **params):
        raise Caught(params)

    monkeypatch.setattr(registry.decode, "bootstrap_diff", diff)
    assert caught(lambda: registry.queries()["bootstrap"](spark, SF)) == ({},)


def test_link_works_features_out_once(spark, monkeypatch):
    def again(*_):
        raise AssertionError("prepared again")

    def score(linker, feats, sides):
        raise Caught(feats, sides)

    monkeypatch.setattr(pipeline, "train", lambda records, truth: pipeline.Linker(pipeline.Settings(), None, [], [], prepared=("s1", "pool", "features")))
    monkeypatch.setattr(pipeline, "prepare", again)
    monkeypatch.setattr(pipeline, "score", score)
    assert caught(lambda: registry.queries()["link"](spark, SF)) == ("features", ("s1", "pool"))
