"""The pipeline's language stage against languages it never learned, and noise."""

import base64
import random

import corpus_pipeline
from tests.llm.conftest import SCHEMA

EN = "the people of this town have lived by their river for a long time and some say that nothing ever changes here while others think the new bridge brought more trade than there was before when all of us had to walk over the hill to reach market with what we made at home".split()
DE = "die leute in dieser stadt leben schon lange an ihrem fluss und manche sagen dass sich hier nichts mehr ändert während andere meinen die neue brücke habe viel handel gebracht als wir noch alle über den berg gehen mussten um auf dem markt zu verkaufen was wir zu hause machten".split()
FI = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä".split()
PL = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa".split()


def test_stage_drops_unlearned_languages_and_noise(spark):
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(words, rng.randint(15, 300)), lang) for k in range(1600) for words, lang in [(EN, "en") if k % 2 else (DE, "de")]]
    strange = [text(FI, 80), text(PL, 80), text(FI, 400), text(PL, 400), text(FI, 25), text(PL, 25)]
    strange += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (100, 1000, 5000)]
    strange += [base64.b64encode(rng.randbytes(n)).decode() for n in (100, 1000)] + [rng.randbytes(500).hex()]
    rows += [(2000 + k, t, None) for k, t in enumerate(strange)] + [(3000, text(EN, 40), None), (3001, text(DE, 200), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t), 0.5, 7, "r", "p", 1, "h") for i, t, lang in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept == {*range(1600), 3000, 3001}
