import random

import numpy as np
import pytest

from quern.llm import defects, garbled

PAIRS = "tbl string, id string, question string, answer string, instruction string, kind string"
SENTENCES = {
    "en": ["The cache keeps the labels that were found before the export.", "Reviewers found 12 cases in which the index was not used.", "Most of the gain came from the ranker and not from the merge step."],
    "de": ["Der Speicher hält die Werte, die vor der Ausgabe gefunden wurden.", "Gutachter zählten 12 Fälle, in denen der Index nicht genutzt wurde.", "Ohne die Liste fällt der Wert, was die Stufe nicht ausgleichen kann."],
    "fr": ["Le cache conserve les étiquettes qui sont trouvées avant chaque export.", "Les relecteurs ont compté 12 cas où le classeur ne trie pas.", "Sans la liste, le rappel perd des points et ne compense pas."],
    "es": ["La caché conserva las etiquetas que están en el registro.", "Los revisores hallaron 12 casos en que el índice no sirve.", "Sin la lista, el caudal cae y la etapa no lo compensa."],
}
QUESTIONS = {"en": "Which setting of the ranker keeps the labels after the merge?", "de": "Welche Einstellung behält der Speicher, wenn die Liste ausfällt?", "fr": "Quelle est la règle que le cache impose avec les étiquettes ?", "es": "¿Qué regla conserva el índice cuando cae la etapa?"}


def corpus(spark, extra):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice("en de fr es".split())
        answer = rng.choice([rng.choice(SENTENCES[lang]), " ".join(rng.sample(SENTENCES[lang], 2)), *([f"About {i} %", f"The nam{i} pool"] if lang == "en" else []), f"nam{i}", SENTENCES[lang][0] + "\n- cold caches\n- late shards", SENTENCES[lang][1] + "\n1. late shards\n2. cold caches"])
        rows.append(("t", f"g{i}", QUESTIONS[lang], answer, None, "x"))
    return spark.createDataFrame(rows + [("t", *e, "x") for e in extra], PAIRS)


CASES = [
    ("e1", QUESTIONS["en"], None, None, "empty"),
    ("e2", QUESTIONS["en"], " ​\xa0\n", None, "empty"),
    ("e3", QUESTIONS["en"], "(None given)", None, "empty"),
    ("e4", QUESTIONS["en"], "—", None, "empty"),
    ("e5", None, "N/A", None, "empty"),
    ("r1", QUESTIONS["en"], "I’m sorry, but I cannot provide details on that. Please ask the owners.", None, "refusal"),
    ("r2", QUESTIONS["de"], "Leider kann ich dazu nichts sagen.", None, "refusal"),
    ("r3", QUESTIONS["fr"], "Navré, il m’est impossible de parler de cela.", None, "refusal"),
    ("r4", QUESTIONS["es"], "Lo siento, no puedo ayudar con esa solicitud.", None, "refusal"),
    ("r5", QUESTIONS["en"], "The console prints “Sorry, I cannot answer” and the ranker was not used.", None, None),
    ("r6", QUESTIONS["en"], "I/O errors are refused by the ranker until the index is rebuilt.", None, None),
    ("c1", QUESTIONS["en"], "Answer: " + QUESTIONS["en"].upper(), None, "copy"),
    ("c2", QUESTIONS["en"], QUESTIONS["en"] + " " + QUESTIONS["en"], None, "copy"),
    ("c3", QUESTIONS["en"], QUESTIONS["en"].replace(" merge?", ""), None, "copy"),
    ("c4", QUESTIONS["en"], QUESTIONS["en"] + " " + SENTENCES["en"][0], None, None),
    ("c6", "Wo legt die Größe der Liste die Werte ab?", "WO LEGT DIE GRÖSSE DER LISTE DIE WERTE AB?", None, "copy"),
    ("c5", QUESTIONS["en"], QUESTIONS["en"], "Repeat the input word for word.", None),
    ("t1", QUESTIONS["en"], SENTENCES["en"][0] + " Reviewers found 12 ca", None, "truncated"),
    ("t2", QUESTIONS["en"], SENTENCES["en"][0] + "\n```\nx = load('a', ", None, "truncated"),
    ("t3", QUESTIONS["en"], SENTENCES["en"][0] + "\n- cold caches\n- la", None, "truncated"),
    ("t4", QUESTIONS["en"], "The cache (cf. the label", None, "truncated"),
    ("t5", QUESTIONS["en"], SENTENCES["en"][0] + "\n```\nx = 1\n```", None, None),
    ("t6", QUESTIONS["en"], SENTENCES["en"][0] + " [Document 1] [Document 2]", None, None),
    ("t7", QUESTIONS["en"], SENTENCES["en"][0] + "\n- late shards\n- cold caches", None, None),
    ("t8", QUESTIONS["en"], "Most of the gain came from the", None, "truncated"),
    ("l1", QUESTIONS["en"], SENTENCES["de"][0], None, "language"),
    ("l2", QUESTIONS["fr"], " ".join(SENTENCES["es"]), "Answer accurately.", "language"),
    ("l3", QUESTIONS["en"], SENTENCES["de"][0], "Answer in German.", None),
    ("l4", QUESTIONS["en"], "The label “überzählige Vektoren, die der Speicher hält” was kept by the ranker.", None, None),
    ("x1", QUESTIONS["en"], "a " * 50_000 + "end.", None, None),
]


def test_defects(spark):
    extra = [c[:4] for c in CASES]
    got = {r["id"]: r["defect"] for r in defects.defects(corpus(spark, [*extra, extra[0], (None, "q", None, None)])).collect()}
    assert {i: got.get(i) for i, *_ in CASES} == {c[0]: c[4] for c in CASES}
    assert not [i for i in got if i and i.startswith("g")] and None not in got


def test_cut_phrases_don_t_vouch_for_themselves(spark):
    """Neither one with an uncommon beginning, nor one that is the answer of a quarter of the rows; whole ones stay whole then."""
    alone = ("cut", QUESTIONS["fr"], "Pour rétablir Begikeja, il", None)
    often = [(f"o{i}", f"{QUESTIONS['en']} {i}", "Seeds 12 gave Dovo", None) for i in range(300)]
    whole = [(f"w{i}", f"{QUESTIONS['en']} {i}", "The nam7 pool", None) for i in range(300)]
    got = {r["id"]: r["defect"] for r in defects.defects(corpus(spark, [alone, *often, *whole])).collect()}
    assert got == {i: "truncated" for i, *_ in [alone, *often]}


def test_defects_of_nothing(spark):
    assert defects.defects(corpus(spark, []).limit(0)).count() == 0


def test_questions_of_tuning_pairs(spark):
    rows = spark.createDataFrame([("a", "do", "q", "o"), ("b", "q2", None, "o"), ("c", "q3", " \t", "o"), ("d", None, None, None)], "id string, instruction string, input string, output string")
    got = {r["id"]: (r["question"], r["instruction"]) for r in defects.sft_pairs(rows).collect()}
    assert got == {"a": ("q", "do"), "b": ("q2", None), "c": ("q3", None), "d": (None, None)}


PLAIN = [
    "Après l’étape, le classeur répète les données égarées à l’équipe.",
    "Größere Pools nützen wenig; für jede Überlappung zählt der Prüfer die Blöcke.",
    "La guía señala más títulos vacíos según el último análisis.",
    "The ranker’s owners say “cheap but honest” — latency is ±5 µs, 3× below…",
]
ODD = ["målt ålder følger æble-listen.", "Команда пишет о модуле заново.", "RELATÓRIO: A CONEXÃO NÃO PERDE A SEÇÃO.", "Reports quote the pair “Ã©” or the mark “�” here.", "étape decomposed", "Σ over λ-terms ≥ 30 °C"]


def texts():
    rng = random.Random(3)
    return [" ".join(rng.choices(PLAIN, k=3)) for _ in range(800)] + ODD * 3


@pytest.mark.parametrize(("codec", "really"), [(c, "utf-8") for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")] + [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252")])
def test_garbled_texts_come_back(spark, codec, really):
    base, hurt = texts(), {}
    for i, t in ((900, PLAIN[0]), (901, PLAIN[1]), (902, PLAIN[2])):
        whole = t.encode(really).decode(codec, "replace") if codec != "cp1252" else "".join(garbled._CHARS["cp1252"].get(b, chr(b)) if b > 127 else chr(b) for b in t.encode(really))
        hurt[i] = (whole, t)
    hurt[903] = (PLAIN[1] + " " + hurt[902][0], PLAIN[1] + " " + PLAIN[2])
    rows = [(i, t) for i, t in enumerate(base)] + [(i, w) for i, (w, _) in hurt.items()] + [(990, None), (991, "")]
    got = {r["doc_id"]: r for r in garbled.garbled(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, mapping string")).collect()}
    assert set(got) == set(hurt)
    if "�" not in "".join(w for w, _ in hurt.values()):
        assert {i: got[i]["restored"] for i in hurt} == {i: t for i, (_, t) in hurt.items()}


def test_twice_garbled_and_lost(spark):
    once = PLAIN[0].encode().decode("latin-1")
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, once.encode().decode("latin-1")), (901, PLAIN[1].encode("cp1252").decode("utf-8", "replace")), (902, "x " * 100_000 + once)]
    got = {r["doc_id"]: r for r in garbled.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {900, 901, 902}
    assert got[900]["restored"] == PLAIN[0] and got[901]["n_lost"] == 8 and got[902]["restored"].endswith(PLAIN[0])


def test_garbled_through_sets_of_two_bytes(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(901, "Le classeur répète les données égarées".encode().decode("gbk"))]
    got = {r["doc_id"]: (r["mapping"], r["restored"]) for r in garbled.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {901: ("utf-8 as gbk", "Le classeur répète les données égarées")}


def test_rare_pairs_of_rare_characters_are_no_information(spark):
    """Without smoothing, characters that only garbled text has would have the highest mutual information of all."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(900 + i, PLAIN[0].encode().decode("latin-1")) for i in range(5)]
    model = garbled.PairModel(garbled.pair_counts(spark.createDataFrame(rows, "doc_id bigint, text string")), "suspects")
    pair = lambda p: np.array([(ord(p[0]) << 21) | ord(p[1])], np.uint64)
    assert model.information(pair("Ã©"))[0] < garbled.SURPRISE < model.information(pair("ré"))[0]


def test_nothing_garbled(spark):
    assert garbled.garbled(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert garbled.garbled(spark.createDataFrame([(1, "plain")], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman"])
def test_frequent_garbling_is_no_normal_text(spark, wrong):
    """A third of the rows, as copies of one text or as a source read in one wrong set, or with lost characters."""
    base = texts()
    bad = PLAIN[0].encode().decode(wrong)
    copies = [(i, t) for i, t in enumerate(base)] + [(10_000 + i, bad) for i in range(len(base) // 2)]
    lost = [(i, t) for i, t in enumerate(base)] + [(10_000 + i, f"Le point {i} : l�tape.") for i in range(len(base) // 2)]
    swapped = [(i, t) for i, t in enumerate(base)] + [(10_000 + i, PLAIN[1].encode("cp1252").decode("mac_roman")) for i in range(len(base) // 2)]
    rng = random.Random(5)
    source = [(i, t) for i, t in enumerate(base)] + [(10_000 + i, f"{i} " + " ".join(rng.choices(PLAIN[:3], k=2)).encode().decode(wrong, "replace")) for i in range(len(base) // 2)]
    others = [(i, t) for i, t in enumerate(base)] + [(10_000 + i, f"{i} " + " ".join(rng.choices(PLAIN[:3], k=2)).encode("cp1252").decode("mac_roman")) for i in range(len(base) // 2)]
    for rows in (copies, lost, swapped, source, others):
        found = garbled.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r["doc_id"] for r in found} == {i for i, _ in rows if i >= 10_000}
        if rows is copies:
            assert {r["restored"] for r in found} == {PLAIN[0]}
