"""Marked texts: units are parted by ¦ with the white space around it."""

import pytest

from claimspan.llm.sentence_units import SentenceModel, candidates, fit_maxent, fit_on, paired, reliable_rows, sentence_units

MARKED = [
    "Dr. Hilme Hest of Kema Agency put it at 3.3 percent, i.e. about 1,945 samples. ¦ They waited ... and then it ended. ¦ \"Who pays?\" asked Edo.",
    "The board met at 4 p.m. Tuesday in Tam Bay. ¦ Jarl left at 11 a.m. ¦ In 1977 it was sold to Loub & Co. ¦ A spokesperson (see Sec. 3.2) declined.",
    "\"It is over. Nobody will pay,\" said Tavo. ¦ \"Nobody asked us.\" ¦ The slogan \"Not here!\" appeared. ¦ He wrote that it \"ignores the toll entirely\".",
    "It is unclear who paid first.¦It opened in 1969. ¦ The film Who Owns the Harbour? opened in 1988. ¦ J. R. Dev and Q. Lia signed it.",
    "Goran Tar vs. Mesou Society was heard by Judge Wale , no. 4 of 2010 . ¦ `` Nobody asked us. '' ¦ The rule -LRB- see Sec. 2 -RRB- applies .",
    "Vgl. S. 2 ff. der Akte, Bd. 2. ¦ Laut Koti stieg der Preis um 5,3 Prozent, d. h. auf 1553 Taler, z. B. am 11. Mai. ¦ „Wer zahlt das?“, fragte Ludo.",
    "« C'est fini. Personne ne paiera », a dit Mme Brap, née en 1956 (cf. p. 4). ¦ L'art. 4 ne s'applique pas. ¦ Quelle erreur pour M. Gesle !",
    "«¿Quién pagará?», preguntó el Sr. Rod. ¦ ¡Nadie lo sabía! ¦ La pág. 2 menciona a la Dra. Skia, aprox. lo previsto.",
    "«Всё кончено. Никто не заплатит», — сказал проф. Гутон. ¦ Дом на ул. Терезен построен в 2014 г. советом. ¦ Кто заплатил?",
    "“项目已经结束。没有人会付钱。”安维卡说。¦卡法兰罗表示：“我们没有收到通知。”¦调查显示……他并未签署2.7版文件。",
    "「もう終わった。誰も払わない。」とテラキは述べた。¦信じられない結果だ！¦第4次計画は79.1億円を必要とする。",
    "डॉ. नेरिका ने कहा कि कीमत 51,4 प्रतिशत बढ़ी। ¦ क्या पीतीग ने सच कहा? ¦ यह असंभव है!",
    "بُني الجسر سنة 1975 ثم أُغلق. ¦ من دفع التكاليف؟ ¦ هذا مستحيل!",
    "ราคาน้ำเพิ่มขึ้น 29,5 เปอร์เซ็นต์ในปีนี้ ¦ ชาวบ้านถามว่าใครจะรับผิดชอบ ¦ We know.",
    "Grekla coal plant\n¦\nSee https://chu.example/ske.html?v=2.1 for details. ¦ ❗ Really?! ¦ No! ¦ When it was cut off at the",
]


@pytest.fixture(scope="module")
def model(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/retrieval_json.parquet").selectExpr("row_id as item_key", "explode(retrieved_chunks.text) as text")
    return fit_on(frame)


def test_marked_texts(model):
    wrong = []
    for marked in MARKED:
        text = marked.replace("\n¦\n", "\n").replace(" ¦ ", " ").replace("¦", "")
        want = [p.strip() for p in marked.split("¦")]
        got = [text[a:b] for a, b in model.units(text)]
        if got != want:
            wrong.append((got, want))
    assert not wrong, wrong


def test_units_cover_everything_but_white_space(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "a. B" * 40_000, "x"), (5, "\"" * 999 + "(" * 999, "x"), (5, "\"" * 999 + "(" * 999, "x"), (6, "\r\nHello. World", "x")] + [(10 + i, m.replace("¦", ""), "x") for i, m in enumerate(MARKED)]
    df = spark.createDataFrame(rows, "k int, text string, certain string")
    texts = {k: t for k, t, _ in rows}
    seen: dict = {}
    for r in sentence_units(df, model).orderBy("k", "sent_no", "char_start").collect():
        seen.setdefault(r.k, []).append((r.sent_no, r.char_start, r.char_end))
    assert not {1, 2, 3} & set(seen)
    assert [texts[6][a:b] for _, a, b in seen[6]] == ["Hello.", "World"]
    for k, units in seen.items():
        if k == 5:
            continue
        assert [n for n, _, _ in units] == list(range(len(units)))
        at = 0
        for _, a, b in units:
            assert not texts[k][at:a].strip() and texts[k][a:b] == texts[k][a:b].strip() and a < b
            at = b
        assert not texts[k][at:].strip()
    assert sentence_units(df.limit(0), model).count() == 0


def test_without_training_rows(spark):
    assert fit_maxent(reliable_rows([])).units("One. two") == [(0, 8)]
    assert fit_on(spark.createDataFrame([], "item_key string, text string")).units("") == []


@pytest.mark.parametrize("opening, closing", ["“”", "„“", "«»", "「」", "()", "（）", "《》", '""', ("``", "''"), ("-LRB-", "-RRB-")])
def test_long_quotations_stay_whole(model, opening, closing):
    inside = ("Nobody asked them here. " * 420).strip()  # 10,000 characters
    line = f"Edo said {opening}{inside}{closing}, and left." if opening == '"' else f"Edo said {opening} {inside} {closing} , and left."
    start = line.index(opening)
    assert [(a, b) for a, b, _ in paired(line)] == [(start, line.rindex(closing) + len(closing))]
    assert model.units(line) == [(0, len(line))]


def test_places_in_numbers_and_addresses_are_candidates_that_the_model_turns_down(model):
    line = "It cost 3.5 million. See https://chu.example/ske.html?v=2.1 for (e.g. here. There) more."
    found = [(c.shape.place, model.ends(c)) for c in candidates(line)]
    assert ("number", False) in found and ("address", False) in found and ("pair", False) in found
    assert [line[a:b] for a, b in model.units(line)] == ["It cost 3.5 million.", line[21:]]


def test_features_reach_over_wide_gaps(model):
    line = "Edo waited" + " " * 500 + ". Then it ended."
    assert next(candidates(line)).word == "waited"
    assert len(model.units(line)) == 2


def test_the_model_decides_as_the_reliable_places_say(spark, model):
    """On texts that it was not fitted on, the model agrees with nearly all places that are certain, and it alone decides."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/retrieval_json.parquet").selectExpr("explode(retrieved_chunks.text) as text").collect() if r.text]
    sure = [(c.certain, model.ends(c)) for t in texts for line in t.splitlines() for c in candidates(line) if c.certain is not None]
    assert len(sure) > 300 and sum(a == b for a, b in sure) / len(sure) > 0.998
    assert not SentenceModel({}).ends(next(candidates("It ended. Then it began.")))
