"""Queries over text features, embeddings and classifiers."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import words
from sitewright.operators import aggregates, features, forests, many_models, models, sampling
from sitewright.operators.language import LanguageProfile
from sitewright.operators.texts import build_revisions
from sitewright.plans import experiments, inputs
from sitewright.plans import sqltext as q
from sitewright.plans.inputs import LANGUAGES, SEED
from sitewright.plans.registry import query
from sitewright.plans.scoring import score_pages, score_url_table
from sitewright.plans.texts import REVISIONS
from sitewright.session import new_table_path
from sitewright.sources.tables import read_parquet, read_spread, save_stage, write_table

EMBEDDING = {"size": 50, "epochs": 5, "window": 10, "min_count": 3}
TERMS = 300

# --- features ----------------------------------------------------------------------------------


def _weights_sql(corpus: str, fitted: str, terms: int, extra: str = "") -> str:
    """TF-IDF of ``corpus`` with vocabulary and idf from ``fitted``."""
    return f""",
    fw as (select doc_id, unnest({q.tokens('text')}) as term from {fitted}),
    vocabulary as (select term, count(distinct doc_id) as df from fw group by term order by count(*) desc, term limit {terms}),
    n as (select count(*) as n from {fitted}),
    tf as (select {extra} doc_id, term, count(*) as tf
           from (select {extra} doc_id, unnest({q.tokens('text')}) as term from {corpus}) group by all),
    z as (select {extra} doc_id, term, tf * (ln((1 + n)::double / (1 + df)) + 1) as z from tf join vocabulary using (term), n),
    norms as (select {extra} doc_id, sqrt(sum(z * z)) as norm from z group by all),
    weights as (select z.*, z / norm as weight from z join norms using (doc_id))"""


@query(
    "f1_tfidf",
    q.using("corpus", _weights_sql("corpus", "corpus", TERMS) + " select doc_id, term, round(weight, 6) as weight from weights"),
)
def f1(spark: SparkSession, folder: str) -> DataFrame:
    weighted, vocabulary = features.tfidf(inputs.corpus(spark, folder), "text", TERMS)
    long = features.long_form(weighted, ["doc_id"], "tfidf", vocabulary.terms)
    return long.withColumn("weight", F.round("weight", 6))


BOW_SQL = """,
    vocabulary as (select term from words group by term order by count(*) desc, term limit 300)
    select doc_id, term, {value} as n from words join vocabulary using (term) group by 1, 2"""


@query("f2_bag_of_words", q.using("words", BOW_SQL.format(value="count(*)::double")))
def f2(spark: SparkSession, folder: str) -> DataFrame:
    counted, vocabulary = features.bag_of_words(inputs.corpus(spark, folder), "text", TERMS)
    return features.long_form(counted, ["doc_id"], "bow", vocabulary.terms, "n")


@query("f2_bag_of_words_binary", q.using("words", BOW_SQL.format(value="1::double")))
def f2_binary(spark: SparkSession, folder: str) -> DataFrame:
    counted, vocabulary = features.bag_of_words(inputs.corpus(spark, folder), "text", TERMS, binary=True)
    return features.long_form(counted, ["doc_id"], "bow", vocabulary.terms, "n")


SETS = f""",
    parts as (select *, case when substr({q.key_hash('doc_id')}, 1, 8) < 'cccccccd' then 'train' else 'test' end as part from labelled),
    train as (select * from parts where part = 'train')"""


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "f3_split_tfidf",
    q.using(
        "labelled",
        SETS + _weights_sql("parts", "train", TERMS, "part,") + " select part, doc_id, term, round(weight, 6) as weight from weights",
    ),
)
def f3(spark: SparkSession, folder: str) -> DataFrame:
    train, test = sampling.split(inputs.labelled(spark, folder), ["doc_id"], 0.8, SEED)
    train, test, vocabulary = features.split_then_tfidf(train, test, "text", TERMS)
    long = features.long_form(_both(train, test), ["part", "doc_id"], "tfidf", vocabulary.terms)
    return long.withColumn("weight", F.round("weight", 6))


@query(
    "f3_split_bag_of_words",
    q.using(
        "labelled",
        SETS
        + f""", vocabulary as (select term from (select unnest({q.tokens('text')}) as term from train)
                               group by term order by count(*) desc, term limit 300)
            select part, doc_id, term, count(*)::double as n
            from (select part, doc_id, unnest({q.tokens('text')}) as term from parts) join vocabulary using (term) group by all""",
    ),
)
def f3_counts(spark: SparkSession, folder: str) -> DataFrame:
    train, test = sampling.split(inputs.labelled(spark, folder), ["doc_id"], 0.8, SEED)
    train, test, vocabulary = features.split_then_bag_of_words(train, test, "text", TERMS)
    return features.long_form(_both(train, test), ["part", "doc_id"], "bow", vocabulary.terms, "n")


BALANCED = f""",
    small as (select *, row_number() over (order by {q.key_hash('doc_id')}, doc_id) as r from train where label = 0),
    size as (select count(*) filter (label = 0) as n, count(*) filter (label = 1) as total from train),
    draws as (select {q.number(q.key_hash('i'))} % n + 1 as r from (select unnest(range(total - n)) as i, n from size)),
    balanced as (select 'train' as part, doc_id, label, md5(text) as text_md5 from train
                 union all select 'train', doc_id, label, md5(text) from draws join small using (r)
                 union all select 'test', doc_id, label, md5(text) from parts where part = 'test')
    select * from balanced"""


def _majority(df: DataFrame) -> int:
    """Size of class 1 in the training part; only the label column is needed for it."""
    train, _ = sampling.split(df, ["doc_id"], 0.8, SEED)
    return train.filter(F.col("label") == 1).count()


@query("f4_text_sets", q.using("labelled", SETS + BALANCED))
def f4(spark: SparkSession, folder: str) -> DataFrame:
    known = save_stage(inputs.labelled(spark, folder), "labelled")
    train, test = features.text_sets(known, "doc_id", "label", 0.8, SEED, 0, _majority(known))
    return _both(train, test).select("part", "doc_id", "label", F.md5("text").alias("text_md5"))


@query("f10_transformer_sets", q.using("labelled", SETS + BALANCED))
def f10(spark: SparkSession, folder: str) -> DataFrame:
    known = save_stage(inputs.labelled(spark, folder), "labelled")
    train, test = features.transformer_sets(known, "doc_id", "label", 0.8, SEED, 0, _majority(known))
    return _both(train, test).select("part", "doc_id", "label", F.md5("text").alias("text_md5"))


def _hash_vector(word: Column) -> Column:
    """Four numbers in [-0.5, 0.5] fixed by the word."""
    parts = [
        sampling.hash_number(F.md5(F.concat_ws(":", word, F.lit(str(i)))), 4) / F.lit(65535.0) - F.lit(0.5)
        for i in range(1, 5)
    ]
    return F.array(*parts)


@query(
    "f6_doc_vector",
    q.using(
        "words",
        """, vocabulary as (select term from words group by term having count(*) >= 3),
             vectors as (select term, list_avg(list_transform([1, 2, 3, 4], lambda i:
                 ('0x' || substr(md5(concat_ws(':', term, i)), 1, 4))::BIGINT / 65535.0::double - 0.5)) as m from vocabulary)
             select doc_id, round(avg(m), 6) as doc_vector from words join vectors using (term) group by 1""",
    ),
)
def f6(spark: SparkSession, folder: str) -> DataFrame:
    corpus = inputs.corpus(spark, folder)
    tokens = words.tokens(F.col("text"))
    known = aggregates.term_counts(corpus, tokens).filter(F.col("tf") >= 3)
    vectors = known.select(F.col("term").alias("word"), _hash_vector(F.col("term")).alias("vector"))
    made = features.doc_vector(corpus, "doc_id", tokens, vectors)
    return made.withColumn("doc_vector", F.round("doc_vector", 6))


@query("f5_word_vectors")
def f5(spark: SparkSession, folder: str) -> DataFrame:
    tokens = inputs.corpus(spark, folder).select(words.tokens(F.col("text")).alias("words"))
    return features.word_vector_table(features.train_word_vectors(tokens, "words", 200, 5, 3, 5))


@query("f6_trained_doc_vector")
def f6_trained(spark: SparkSession, folder: str) -> DataFrame:
    corpus = save_stage(inputs.corpus(spark, folder).select("doc_id", words.tokens(F.col("text")).alias("words")), "words")
    model = features.train_word_vectors(corpus, "words", 200, 5, 3, 5)
    return features.doc_vector(corpus, "doc_id", F.col("words"), features.word_vector_table(model))


@query("f7_document_embeddings")
def f7(spark: SparkSession, folder: str) -> DataFrame:
    corpus = inputs.corpus(spark, folder).select("doc_id", words.tokens(F.col("text")).alias("words"))
    model = features.train_word_vectors(corpus, "words", **EMBEDDING)
    return features.document_embeddings(corpus, "doc_id", "words", model)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled clean documents, written once so that later passes do not clean them again."""
    known = inputs.labelled(spark, folder).select(F.col("doc_id").alias("key"), "text", "label", "source", "lang")
    return save_stage(known, "labelled")


def _features(spark: SparkSession, folder: str, **more) -> tuple[DataFrame, features.FeatureSet]:
    documents = _documents(spark, folder)
    fitted = features.fit_features(documents, "text", TERMS, language="lang", embedding=EMBEDDING, **more)
    return documents, fitted


@query("f8_assembled_features")
def f8(spark: SparkSession, folder: str) -> DataFrame:
    documents, fitted = _features(spark, folder)
    ready = features.assemble(documents, "key", fitted, keep=["label"])
    return ready.select("key", "label", features.vector_to_array("features").alias("features"))


@query("f9_zip_features")
def f9(spark: SparkSession, folder: str) -> DataFrame:
    documents, fitted = _features(spark, folder)
    with_zip = documents.withColumn("zip", 1000 + F.col("key") % 9000)
    ready = save_stage(features.assemble(with_zip, "key", fitted, keep=["label", "zip"]), "feature-rows")
    train, test = sampling.split(ready, ["key"], 0.8, SEED)
    both = _both(train, test)
    return both.select("key", "zip", "label", "part", features.vector_to_array("features").alias("features"))


# --- models ---------------------------------------------------------------------------------


ROWS_PER_PART = 20_000  # an optimizer step is a job; parts of this size keep its tasks worth starting

# What several queries of one session share: feature sets and the classifier of a folder of tables.
_SHARED: dict[tuple, object] = {}


def _file_state(spark: SparkSession, folder: str) -> tuple:
    """Number, sizes and times of the files behind the tables that fits read: other files, other fits."""
    files = [
        read_parquet(spark, folder, table).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        for table in ("documents", "labels")
    ]
    found = files[0].unionByName(files[1]).distinct()
    return tuple(found.agg(F.count("*"), F.sum(F.xxhash64(*found.columns).cast("decimal(38,0)"))).first())


def _shared(spark: SparkSession, folder: str, name: str, make):
    key = (spark.sparkContext.applicationId, folder, name, _file_state(spark, folder))
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _sets(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame, features.FeatureSet, int]:
    """Train and test features (saved, since a fit reads them many times) and the training size."""
    documents = _documents(spark, folder)
    settings = {"language": "lang", "embedding": EMBEDDING, **options}
    train, test, fitted = features.training_sets(documents, "key", "text", "label", 0.8, SEED, TERMS, **settings)
    train, test = save_stage(train, "train"), save_stage(test, "test")
    size = train.count()
    return train.coalesce(math.ceil(size / ROWS_PER_PART) or 1), test, fitted, size


def _balanced_sets(spark: SparkSession, folder: str, **options):
    labels = read_parquet(spark, folder, "labels").select("quality")
    total = labels.filter("quality = 1").count()
    name = f"balanced {sorted(options.items())}"
    return _shared(spark, folder, name, lambda: _sets(spark, folder, oversample_value=0, total=total, **options))


def _plain_sets(spark: SparkSession, folder: str):
    return _shared(spark, folder, "plain", lambda: _sets(spark, folder))


def _classifier(spark: SparkSession, folder: str):
    train, _, _, size = _balanced_sets(spark, folder)
    return _shared(spark, folder, "classifier", lambda: models.logistic_l1(size).fit(train))


def _trained(spark: SparkSession, folder: str) -> models.TrainedModel:
    train, test, _, _ = _balanced_sets(spark, folder)
    return models.evaluate(_classifier(spark, folder), train, test)


@query("m1_logistic_l1")
def m1(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder).test.select("key", "label", "proba", "prediction")


@query("m2_random_forest")
def m2(spark: SparkSession, folder: str) -> DataFrame:
    """300 trees of 2,000 draws each, 15 deep at most, nodes of under 8 draws not split."""
    train, test, _, _ = _plain_sets(spark, folder)
    settings = forests.TreeSettings(depth=15, min_split=8)
    fitted = forests.fit_forest(train, "key", trees=300, sample=2000, settings=settings, seed=SEED)
    return fitted.transform(test).select("key", "label", "proba", "prediction")


@query(
    "m3_bernoulli_bayes",
    q.using(
        "labelled",
        SETS
        + f""", present as (select distinct doc_id, part, label, term from
                  (select doc_id, part, label, unnest({q.tokens('text')}) as term from parts)),
          vocabulary as (select term from (select unnest({q.tokens('text')}) as term from parts)
                         group by term order by count(*) desc, term limit 100),
          classes as (select label as class, count(*) as n from train group by 1),
          hits as (select label as class, term, count(*) as c from present where part = 'train' group by 1, 2),
          odds as (select class, term, (coalesce(c, 0) + 1.0::double) / (n + 2) as p
                   from classes cross join vocabulary left join hits using (class, term)),
          base as (select class, sum(ln(1 - p)) as b from odds group by 1),
          shift as (select doc_id, o.class, sum(ln(p) - ln(1 - p)) as s from present join odds o using (term)
                    where part = 'test' group by 1, 2)
          select t.doc_id as key, cast(k.class as integer) as class,
                 round(ln(n::double / (select sum(n) from classes)) + b + coalesce(s, 0), 6) as score
          from (select doc_id from parts where part = 'test') t cross join classes k join base using (class)
          left join shift s on s.doc_id = t.doc_id and s.class = k.class""",
    ),
)
def m3(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    train, test, _ = features.training_sets(documents, "key", "text", "label", 0.8, SEED, 100)
    scored = models.BernoulliBayes.fit(train).transform(test)
    return scored.select("key", F.posexplode("scores").alias("class", "score")).withColumn("score", F.round("score", 6))


@query("m4_train_report")
def m4(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder).report()


@query("m4_train_histograms")
def m4_histograms(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder).histograms()


@query("m4_prebuilt_accuracies")
def m4_prebuilt(spark: SparkSession, folder: str) -> DataFrame:
    train, test, _, size = _balanced_sets(spark, folder, prebuild=True)
    return models.train_model(models.logistic_l1(size), train, test).accuracies()


@query("m5_cross_validation")
def m5(spark: SparkSession, folder: str) -> DataFrame:
    train, test, _, size = _plain_sets(spark, folder)
    everything = train.unionByName(test)
    return models.grid_table(models.cross_validate(models.logistic_l1(size), everything, "key", folds=5))


@query("m6_logistic_search")
def m6(spark: SparkSession, folder: str) -> DataFrame:
    """All 49 points in ten folds: 490 fits made together."""
    train, test, _, _ = _plain_sets(spark, folder)
    return many_models.search_logistic(train.unionByName(test), "key", folds=10, seed=SEED)


def _saved_scorer(spark: SparkSession, folder: str) -> tuple[str, features.FeatureSet, object]:
    """One saved scorer per session and folder."""
    _, _, fitted, _ = _balanced_sets(spark, folder)
    classifier = _classifier(spark, folder)

    def save() -> str:
        path = new_table_path(spark, "scorer")
        models.scoring_model(fitted, classifier).write().save(path)
        return path

    return _shared(spark, folder, "scorer", save), fitted, classifier


def _unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.corpus(spark, folder).select(F.col("doc_id").alias("key"), "text", "lang", "source")


@query("m8_save_and_load")
def m8(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the loaded model, and whether those of the model in memory are the same."""
    path, fitted, classifier = _saved_scorer(spark, folder)
    corpus = save_stage(_unlabelled(spark, folder), "unlabelled")
    before = models.predict(models.scoring_model(fitted, classifier), corpus)
    after = models.predict(PipelineModel.load(path), corpus)
    renamed = before.select("key", F.col("predictions_proba").alias("proba_before"), F.col("predictions").alias("before"))
    same = (F.col("proba_before") == F.col("predictions_proba")) & (F.col("before") == F.col("predictions"))
    return after.join(renamed, "key").select("key", "predictions_proba", "predictions", same.alias("equal"))


@query("m9_predict")
def m9(spark: SparkSession, folder: str) -> DataFrame:
    path, _, _ = _saved_scorer(spark, folder)
    return models.predict(PipelineModel.load(path), _unlabelled(spark, folder))


@query("m10_coefficients")
def m10(spark: SparkSession, folder: str) -> DataFrame:
    _, fitted, classifier = _saved_scorer(spark, folder)
    return models.coefficient_table(classifier, fitted, size=20)


@query("m11_repeated_splits")
def m11(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the test accuracy over 100 splits: 100 fits made together."""
    train, test, _, _ = _plain_sets(spark, folder)
    return experiments.repeated_accuracy(train.unionByName(test), "key")


@query("m12_embedding_curve")
def m12(spark: SparkSession, folder: str) -> DataFrame:
    """Mean test accuracy of five fits for each of six shares of the documents with word vectors of 200 numbers."""
    embedding = {"size": 200, "epochs": 5, "window": 3, "min_count": 2}
    return experiments.embedding_size_curve(_documents(spark, folder), "key", "text", 400, embedding)


@query("m13_revision_sensitivity")
def m13(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of ten fits for each text revision, with document embeddings."""
    documents = read_spread(spark, folder, "documents", "doc_id")
    labels = read_parquet(spark, folder, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    made = build_revisions(documents, "doc_id", "text", "lang", LANGUAGES, REVISIONS).withColumnRenamed("doc_id", "key")
    return experiments.revision_sensitivity(made.join(labels, "key"), "key", "text", TERMS, EMBEDDING)


def _with_zip(spark: SparkSession, folder: str) -> DataFrame:
    base = inputs.labelled(spark, folder).select(F.col("doc_id").alias("key"), "text", "lang", "label")
    zips = inputs.companies(spark, folder).select(
        F.col("btw").alias("key"), F.coalesce("activity_zip", "main_zip").alias("zip")
    )
    return save_stage(base.join(zips, "key"), "zips")  # scored, and joined with its scores


@query("m14_zip_export")
def m14(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions for all labelled rows by a model fitted on all of them."""
    documents = _documents(spark, folder)
    fitted = features.fit_features(documents, "text", TERMS, language="lang", embedding=EMBEDDING)
    ready = save_stage(features.assemble(documents, "key", fitted, keep=["label"]), "full")
    classifier = models.logistic_l1(ready.count()).fit(ready)
    known = _with_zip(spark, folder)
    predicted = models.predict(models.scoring_model(fitted, classifier), known)
    return models.export_by_zip(predicted, known, "key", "zip", "label")


@query("m14_zip_export_test")
def m14_test(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions for the test part by a model fitted on the training part."""
    path, _, _ = _saved_scorer(spark, folder)
    _, test = sampling.split(_with_zip(spark, folder), ["key"], 0.8, SEED)
    return models.export_by_zip(models.predict(PipelineModel.load(path), test), test, "key", "zip", "label")


@query("m15_score_pages")
def m15(spark: SparkSession, folder: str) -> DataFrame:
    """HTML table to predictions: fetch, language, switch, clean, score."""
    path, _, _ = _saved_scorer(spark, folder)
    linked = inputs.linked(spark, folder).select("page_id", "url", "html")
    profile = LanguageProfile.fit(read_spread(spark, folder, "documents", "doc_id"), "text", "lang")
    return score_pages(linked, linked, profile, LANGUAGES, PipelineModel.load(path), "lang")


@query("m15_score_url_file")
def m15_file(spark: SparkSession, folder: str) -> DataFrame:
    """A delimited file of URLs to predictions: read, fetch, language, switch, clean, score."""
    path, _, _ = _saved_scorer(spark, folder)
    linked = inputs.linked(spark, folder).select("page_id", "url", "html")
    file = write_table(linked.select("page_id", "url"), new_table_path(spark, "urls"))
    profile = LanguageProfile.fit(read_spread(spark, folder, "documents", "doc_id"), "text", "lang")
    return score_url_table(file, linked, profile, LANGUAGES, PipelineModel.load(path), "lang")


@query("m16_sector_model")
def m16(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    sector = words.sector_prefix(F.substring("source", 4, 2))
    chosen = save_stage(documents.filter(sector.startswith("1")), "sector")
    total = max(150, chosen.filter("label = 0").count())
    train, test, fitted = features.training_sets(
        chosen, "key", "text", "label", 0.7, SEED, 200, oversample_value=0, total=total, embedding=EMBEDDING
    )
    train = save_stage(train, "train")
    classifier = models.logistic_l1(train.count()).fit(train)
    return models.coefficient_table(classifier, fitted, size=15)
