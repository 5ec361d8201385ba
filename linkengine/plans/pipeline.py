"""Train on a labelled split, predict another: the stages of record linkage in order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_records, scramble
from ..operators import blocking, collective, decode, features, model, stats, translit
from ..sources.stage import written
from ..sources.tables import assert_ids, id_lists, read_source


@dataclass
class Settings:
    """``rounds`` is the most that a fold may take; the full model takes what the folds needed.

    ``pruner``, ``translit`` and ``combine`` add the learned pre-ranker, the transliterated channels and the combiner.
    """

    top: int = 50
    rounds: int = 30
    depth: int = 4
    folds: int = 2
    lam: float = 1.3
    mode: str = "hard"
    miss: float = 0.0
    threshold: float | None = None
    pruner: bool = False
    translit: bool = False
    combine: bool = False

    def channels(self) -> list[blocking.Channel]:
        return blocking.SPARSE + (blocking.translit_channels() if self.translit else [])

    def names(self) -> list[str]:
        """Features of a pair, in order."""
        known = features.meta_names([c.name for c in self.channels()])
        return known + features.FEATURES[len(features.meta_names()) :]


@dataclass
class Linker:
    """A fitted classifier with the breakpoints of its calibration and, where the settings ask for them, the other models."""

    settings: Settings
    classifier: PipelineModel
    xs: list[float]
    ys: list[float]
    pruner: PipelineModel | None = None
    combiner: PipelineModel | None = None
    dictionary: list[tuple[str, str]] = field(default_factory=list)
    #: (S1, pool, features) of the records that it was trained on, for :func:`predict` on the same ones; not saved.
    prepared: tuple[DataFrame, DataFrame, DataFrame] | None = field(default=None, compare=False, repr=False)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for name in ("classifier", "pruner", "combiner"):
            if getattr(self, name) is not None:
                getattr(self, name).write().overwrite().save(f"{path}/{name}")
        table = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        table(list(zip(self.xs, self.ys, strict=True)), "x double, y double", "breakpoints")
        table(self.dictionary, "native_token string, latin_token string", "dictionary")
        table([(json.dumps(asdict(self.settings)),)], "settings string", "settings")

    @classmethod
    def load(cls, path: str, settings: Settings | None = None) -> Linker:
        spark = SparkSession.active()
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        own = settings or Settings(**json.loads(read("settings").first()[0]))
        rows = read("breakpoints").orderBy("x").collect()
        others = {n: PipelineModel.load(f"{path}/{n}") for n, asked in (("pruner", own.pruner), ("combiner", own.combine)) if asked}
        return cls(own, PipelineModel.load(f"{path}/classifier"), [r["x"] for r in rows], [r["y"] for r in rows], dictionary=[tuple(r) for r in read("dictionary").collect()], **others)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Raw records of the three tab-separated sources of a split, their ids checked."""
    out = None
    for k in (1, 2, 3):
        own = read_source(spark, f"{folder}/{split}/{split}_source{k}.tsv", f"S{k}")
        assert_ids(own, f"S{k}-")
        out = own if out is None else out.unionByName(own)
    return out


def _spelt(norm: DataFrame, settings: Settings, dictionary: list[tuple[str, str]]) -> DataFrame:
    """Records with the transliterated texts that the channels ask for."""
    if not settings.translit:
        return norm
    words = norm.sparkSession.createDataFrame(dictionary, "native_token string, latin_token string")
    for raw, out in (("raw_name", "translit_name"), ("raw_addr", "translit_addr")):
        norm = translit.apply(norm, words, raw, out)
    return written(norm, "spelt")


def prepare(records: DataFrame, settings: Settings, dictionary: list[tuple[str, str]] | None = None, pruner=None, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(S1, pool, features of the candidates) of raw records; ``pruner`` is None, a model or a function of the union that fits one.

    ``hits`` are rows of further channels, such as dense lists (:func:`dense.dense_channels`).
    """
    norm = written(normalise_records(records), "records")
    rows = _spelt(norm, settings, dictionary or [])
    s1, pool = rows.where("source = 'S1'"), rows.where("source <> 'S1'")
    if pruner is None:
        cands = blocking.candidates(s1, pool, settings.channels(), top=settings.top, extra=hits)
    else:
        union = written(blocking.with_prune_features(blocking.union(s1, pool, settings.channels(), extra=hits)), "union")
        cands = model.prune_by(pruner(union) if callable(pruner) else pruner, union, settings.top)
    cands = written(cands, "candidates")
    feats = features.pair_features(cands, s1, pool, written(stats.token_stats(norm), "stats"), [c.name for c in settings.channels()])
    return s1, pool, written(feats, "features")


def _collective(feats: DataFrame, scored: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Combiner rows of scored pairs."""
    side = pool.select(F.col("entity_id").alias("cand_id"), F.col("norm_name").alias("name"), F.col("norm_addr").alias("addr"), F.col("house_number").alias("house"), F.col("postcodes").alias("post"))
    near = collective.sibling_support(scored.join(side, "cand_id"))
    return written(model.combiner_input(feats, scored, collective.entity_context(scored), near, collective.competition(scored)), "combiner")


def train(records: DataFrame, truth: DataFrame, settings: Settings | None = None, hits: DataFrame | None = None) -> Linker:
    """Fit all models that the settings ask for on labelled raw records."""
    settings = settings or Settings()
    out = Linker(settings, None, [], [])
    if settings.translit:
        norm = written(normalise_records(records), "records")
        pairs = translit.pairs_of(truth, norm.where("source = 'S1'"), norm.where("source <> 'S1'"))
        out.dictionary = [(r["native_token"], r["latin_token"]) for r in translit.learn(pairs).collect()]  # learned words only: a short list

    def pruner(union: DataFrame) -> PipelineModel:
        out.pruner = model.train_pruner(union, truth, rounds=settings.rounds, depth=settings.depth)
        return out.pruner

    out.prepared = s1, pool, feats = prepare(records, settings, out.dictionary, pruner if settings.pruner else None, hits)
    names = settings.names()
    rows = written(model.labelled(feats, truth), "labelled")
    oof, best = model.folds_fitted(rows, names, k=settings.folds, rounds=settings.rounds, depth=settings.depth)
    out.classifier = model.fit(rows, names, rounds=model.full_rounds(best), depth=settings.depth)
    oof = written(oof.select("s1_id", "cand_id", "label", "p"), "oof")
    if settings.combine:
        more = model.labelled(_collective(feats, oof, s1, pool), truth)
        own = [c for c in more.columns if c not in model.NOT_FEATURES]
        oof, best = model.folds_fitted(more, own, k=settings.folds, rounds=settings.rounds, depth=settings.depth)
        out.combiner = model.fit(more, own, rounds=model.full_rounds(best), depth=settings.depth)
        oof = written(oof.select("s1_id", "cand_id", "label", model.floor_mask(F.col("p1"), F.col("p")).alias("p")), "combined")
    out.xs, out.ys = decode.breakpoints(decode.fit_isotonic(oof))
    return out


def score(linker: Linker, feats: DataFrame, sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Calibrated s1_id, cand_id, p of a feature table; the combiner needs the records of both ``sides``."""
    raw = model.predict(linker.classifier, feats, linker.settings.names()).select("s1_id", "cand_id", "p")
    if linker.combiner is not None:
        rows = _collective(feats, written(raw, "first"), *sides)
        names = [c for c in rows.columns if c not in model.NOT_FEATURES]
        raw = model.predict(linker.combiner, rows, names).select("s1_id", "cand_id", model.floor_mask(F.col("p1"), F.col("p")).alias("p"))
    return raw.select("s1_id", "cand_id", decode.interpolated(F.col("p"), linker.xs, linker.ys).alias("p"))


def predict(linker: Linker, records: DataFrame, hits: DataFrame | None = None, prepared: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched, candidate) id lists, one row for each S1; ``prepared`` is what :func:`prepare` gave for these records, if it is there."""
    s1, pool, feats = prepared or prepare(records, linker.settings, linker.dictionary, linker.pruner, hits)
    s = linker.settings
    scored = written(score(linker, feats, (s1, pool)), "scored")
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    return id_lists(decode.postprocess(scored, s.lam, s.mode, s.miss, s.threshold), ids), id_lists(scored, ids)


def scrambled_drop(linker: Linker, records: DataFrame, truth: DataFrame) -> float:
    """Macro F-beta lost when every letter is permuted: what a model has learned of the words themselves."""
    ids = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    mixed = records.withColumns({c: scramble(F.col(c)) for c in ("raw_name", "raw_addr")})

    def quality(rows: DataFrame) -> float:
        matched, _ = predict(linker, rows)
        pairs = matched.select("s1_id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("cand_id"))
        return decode.macro_f(pairs, truth, ids).first()["macro_f05"]

    return quality(records) - quality(mixed)
