"""Language identification: held-out accuracy, and what each kind of evidence does."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tidemark.llm.languages import TextModel, declared_language, document_records, fit_text_model, host_of, identify, op8_language, page_records, visible_text
from tidemark.session import table


def test_held_out_documents(spark, sf):
    docs = table(spark, sf, "documents").where("lang is not null")
    held = docs.where("doc_id % 3 = 0")
    model = fit_text_model(docs.where("doc_id % 3 <> 0"))
    got = identify(document_records(held), model).join(held.select("doc_id", F.col("lang").alias("truth"), F.length("text").alias("n")), "doc_id").where("n >= 20")
    share = got.agg(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert share >= 0.97


def test_every_row_of_both_tables_gets_a_language(spark, tiny):
    got = op8_language(spark, tiny).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r.doc_id for r in table(spark, tiny, "documents").select("doc_id").collect())
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(r.page_id for r in table(spark, tiny, "pages").select("page_id").collect())
    assert all(r.lang and 0 < r.probability <= 1 for r in got)


def test_declared_language_and_visible_text():
    assert declared_language('<HTML class="x" lang="de-AT">') == "de"
    assert declared_language("<body xml:lang='FR'>") == "fr"
    assert declared_language('<meta http-equiv="content-language" content="es">') == "es"
    assert declared_language("<p lang=en>") is None
    assert declared_language('<meta content="it-IT" name=Content-Language>') == "it"
    assert declared_language('<meta http-equiv="content-language" content="es"><html lang=pt>') == "pt"
    assert declared_language("<html>lang=de") is None and declared_language("<html lang=d") is None and declared_language("<html><body lang='da'>") == "da"
    assert declared_language("<html " + "data-x='yyyy' " * 20_000 + "lang=de>") == "de"
    assert declared_language("<html " * 50_000) is None and declared_language("<html lang" + " " * 300_000) is None
    assert visible_text("a<script>x<b></script>b<!-- c --><i>d</i>&amp;<style>z").split() == ["a", "b", "d", "&"]


def test_hosts(spark):
    urls = ["https://User@WWW.Site.example.DE:80/x?y#z", "ftp://a/b", "no url", None, "http://"]
    assert [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h")).collect()] == ["www.site.example.de", "a", None, None, None]


MODEL = [("de", "der die das und ist nicht ein eine mit auf " * 20), ("en", "the of and to in that is was for it with " * 20)]


def test_priors_decide_where_the_text_says_nothing(spark):
    model = TextModel.fit(iter(MODEL))
    pages = [(i, f"http://h.de/{i}", "der die und ist nicht eine") for i in range(40)] + [(100 + i, f"http://h.com/{i}", "the of and that is was for it") for i in range(40)] + [(900, "http://h.de/x", ""), (901, "http://h.com/x", None)]
    got = {r.page_id: r.lang for r in identify(page_records(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    assert got[900] == "de" and got[901] == "en" and got[0] == "de" and got[100] == "en"


def test_nulls_repeats_empty_tables_and_no_model(spark):
    model = TextModel.fit(iter(MODEL))
    docs = spark.createDataFrame([(None, None, None, "q"), (1, "der die das", "s", None), (1, "der die das", "s", None)], "doc_id long, text string, source string, declared string")
    assert sorted(r.lang for r in identify(document_records(docs), model).where("doc_id = 1").collect()) == ["de", "de"]
    assert identify(document_records(docs), model).count() == 3
    assert identify(document_records(docs.limit(0)), model).count() == 0
    assert identify(document_records(docs), TextModel.fit(iter(()))).count() == 0
    assert fit_text_model(docs.withColumn("lang", F.lit(None).cast("string"))).languages == ()


def test_query_is_the_posterior_worked_out_by_hand(spark, tiny):
    docs = table(spark, tiny, "documents")
    model = fit_text_model(docs)
    n, records = len(model.languages), []
    for r in docs.collect():
        records.append({"id": ("d", r.doc_id), "host": r.source, "domain": r.source, "suffix": None, "declared": None, "text": r.text or ""})
    for r in table(spark, tiny, "pages").collect():
        match = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", r.url or "")
        host = match.group(1).lower() if match else None
        labels = host.split(".") if host else []
        records.append({"id": ("p", r.page_id), "host": host, "domain": ".".join(labels[-2:]) if host else None, "suffix": labels[-1] if host else None, "declared": declared_language(r.html or ""), "text": visible_text(r.html or "")})
    for r in records:
        raw = [math.exp(0.1 * s) for s in model.score(r["text"])]
        r["r"] = [x / sum(raw) for x in raw]
    total = [sum(r["r"][i] for r in records) for i in range(n)]
    sums = {}
    for field in ("host", "domain", "declared", "suffix"):
        for r in records:
            own = sums.setdefault((field, r[field]), [0.0] * n)
            for i in range(n):
                own[i] += r["r"][i]
    expected = {}
    for r in records:
        top = [(t + 1) / (sum(total) + n) for t in total]
        domain = [max(a - b, 0) for a, b in zip(sums["domain", r["domain"]], r["r"])]
        prior = [(d + 20 * t) / (sum(domain) + 20) for d, t in zip(domain, top)]
        host = [max(a - b, 0) for a, b in zip(sums["host", r["host"]], r["r"])]
        prior = [(h + 10 * p) / (sum(host) + 10) for h, p in zip(host, prior)]
        weight = [a * p for a, p in zip(r["r"], prior)]
        for field in ("declared", "suffix"):
            if r[field] is not None:
                weight = [w * (s + t) / (whole + 1) for w, s, t, whole in zip(weight, sums[field, r[field]], top, total)]
        best = max(range(n), key=lambda i: weight[i])
        expected[r["id"]] = (r["declared"], model.languages[max(range(n), key=lambda i: r["r"][i])], model.languages[best], weight[best] / sum(weight))
    got = {("p", r.page_id) if r.doc_id is None else ("d", r.doc_id): r for r in op8_language(spark, tiny).collect()}
    assert got.keys() == expected.keys()
    for i, (declared, text_lang, lang, probability) in expected.items():
        assert (got[i].declared, got[i].text_lang, got[i].lang) == (declared, text_lang, lang) and abs(got[i].probability - probability) < 2e-6


def test_very_long_texts_clashing_columns_and_ties(spark):
    model = TextModel.fit(iter(MODEL))
    schema = "doc_id long, text string, source string, host string, domain string, suffix string, page_id int, r0 double, __host string"
    long = "der die das und ist nicht " * 60_000
    docs = spark.createDataFrame([(1, long, "s", "x", "y", "z", 5, 0.5, "h"), (2, "", "t", "x", "y", "z", 5, 0.5, "h"), (3, "12", "t", "x", "y", "z", 5, 0.5, "h")], schema)
    got = {r.doc_id: r for r in identify(document_records(docs), model).collect()}
    assert got[1].lang == "de" and got[1].page_id is None and got[1].host == "s"
    tied = spark.createDataFrame([(i, "", "t") for i in range(4)], "doc_id long, text string, source string")
    assert {(r.lang, r.probability) for r in identify(document_records(tied), model).collect()} == {("de", 0.5)}
