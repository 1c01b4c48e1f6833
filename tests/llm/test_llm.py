"""The operators for training data, against references, brute force and edge cases."""

import base64
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from cohortloom.llm import canonical, clusters, leakage, quality, readability, setjoin, splitter, syllables, terms, tokenizer, vectors

ODD = ["", None, " ", "\n\n", "a", "é" * 10, "x" * 50_000, "<|endoftext|>", "　", "1 2 3", "​"]


# p8


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_back(reference):
    own = tokenizer.encoder()
    rng = random.Random(1)
    letters = "ab zT\n\t'’sé日本 \x1c\x85​12²Ⅷ.,<|endoftext|>̈🎉\r-_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + [t for t in ODD if t]
    texts += ["ab" * 4000, "\n" * 3000 + "x", "The patient's BP wasn't 120/80mmHg; she'll re-check."]
    for text in texts:
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert own.decode(ids).decode() == text


def test_ids_of_empty_null_and_repeated_texts(spark):
    rows = [(1, "", 0), (2, None, 0), (3, "a b", 0), (3, "a b", 0)]
    df = spark.createDataFrame(rows, "k long, t string, ids int")
    found = sorted((r["k"], r["ids"]) for r in tokenizer.encode_column(df, "k", "t").collect())
    assert found == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    back = tokenizer.decode_column(tokenizer.encode_column(df, "k", "t"), "k", "ids").collect()
    assert sorted(r["text"] for r in back) == ["", "", "a b", "a b"]
    assert tokenizer.encode_column(df.where("k > 9"), "k", "t").count() == 0


# p9

PASSAGE = (
    "The old gardener kept seven green parrots in a wooden shed behind the station and taught every one of them to whistle "
    "a different tune before the winter train arrived from the northern coast."
)


def leaks(spark, docs, items=((1, PASSAGE),), **rule):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(items), "item_id long, passage string")
    return sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i, rule=leakage.LeakRule(**rule)).collect())


def test_leaks_in_whole_in_part_and_altered(spark):
    words = PASSAGE.split()
    altered = [w for i, w in enumerate(words) if i != 9]
    altered[20] = "quite"
    docs = [
        "Before. " + PASSAGE + " After.",
        "Something else " + " ".join(words[5:27]) + " and more",
        PASSAGE.upper().replace(" ", "\n"),
        " ".join(altered),
        PASSAGE.replace("parrots", "par-\nrots"),
        " ".join(words[:12]) + " but then nothing",
        " ".join(random.Random(2).sample(words, len(words))),
        "Nothing of that kind stands here at all.",
        *ODD,
    ]
    assert leaks(spark, docs) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert leaks(spark, docs, block_words=1) == leaks(spark, docs)


def test_stock_sentences_are_no_leaks(spark):
    stock = "Please bring all of your medicines and this sheet with you to every visit so that the team can go over them."
    docs = [f"Note {i}. {stock}" for i in range(30)] + [PASSAGE]
    assert leaks(spark, docs, [(1, f"{PASSAGE} {stock}"), (2, stock), (3, None), (4, "")]) == [(30, 1)]
    assert leaks(spark, [], [(1, PASSAGE)]) == []
    assert leaks(spark, docs, []) == []


def test_copies_of_a_leak_make_no_stock_sentence(spark):
    other = "A lame heron stood all summer on the roof of the mill and watched how the boys mended their blue kites near the weir."
    leaking = f"Seen today. {PASSAGE} Plan as before."
    docs = [leaking] * 40 + [f"Visit {i}: the wound was dry." for i in range(80)]
    assert leaks(spark, docs, [(1, f"{PASSAGE} {other}")]) == [(i, 1) for i in range(40)]
    docs = [f"Visit {i} for review. {PASSAGE} {other} The wound {i} was dry." for i in range(20)]
    assert leaks(spark, docs, [(1, f"{PASSAGE} {other}")]) == [(i, 1) for i in range(20)]


def test_stock_sentences_are_told_in_small_tables_and_from_short_alignments(spark):
    stock = "Call the unit or the emergency desk if any concern comes up after you get home."
    own = "The old gardener kept seven green parrots in a wooden shed."
    docs = [f"Day {i}. {stock}" for i in range(4)] + [f"{stock} {own[:44]}."]
    other = "A lame heron stood all summer on the roof of the mill."
    assert leaks(spark, docs, [(1, f"{PASSAGE} {stock} {own}"), (2, f"{stock} {other}")]) == []


@pytest.mark.parametrize("share", [0.01, 0.09, 0.5])
@pytest.mark.parametrize("block_words", [2_000_000, 1])
def test_whole_copies_are_found_however_many_there_are(spark, share, block_words):
    other = "A lame heron stood all summer on the roof of the mill and watched how the boys mended their blue kites near the weir."
    n = int(200 * share)
    docs = [f"Visit {i} on day {i * 7}. {PASSAGE} {other} Plan {i}." for i in range(n)] + [f"Visit {i}: the wound was dry." for i in range(200 - n)]
    assert leaks(spark, docs, [(1, f"{PASSAGE} {other}"), (2, "The harbour master counted every red sail before the storm came in and wrote the sum on a slate by the door of the tower.")], block_words=block_words) == [(i, 1) for i in range(n)]


def test_words_parted_at_line_ends(spark):
    assert leakage.words_of("obser-\r\nvation obser- \nvation obser-\rvation obser-\nvation a-b 5-\n6") == ["observation"] * 4 + ["a", "b", "5", "6"]


def test_template_words_are_told_over_all_passages(spark):
    style = "The patient was seen on the ward by the team and was said to have"
    items = [(i, f"{style} {w} since the first week of the year in the old town.") for i, w in enumerate(("gout", "mumps", "croup", "scurvy", "rickets", "pellagra"))]
    docs = [f"{style} asthma since the first week of the year in the old town.", items[2][1]]
    rule = {"least_content": 1, "least_seeds": 1}
    assert leaks(spark, docs, items, **rule) == leaks(spark, docs, items, block_words=1, **rule) == [(1, 2)]


def test_winnowing_keeps_a_fingerprint_of_every_long_shared_span():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(1, 9, 80).astype(np.uint64), rng.integers(1, 9, 80).astype(np.uint64)
        b[30:40] = a[50:60]
        x, y = leakage._mix(a, 3), leakage._mix(b, 3)
        assert set(x[leakage.winnow(x, 4)]) & set(y[leakage.winnow(y, 4)])


# p10, p3


@pytest.mark.parametrize(
    "text,prose",
    [
        ("He was seen in the clinic and felt well. There was no pain in the knee.", True),
        ("HE WAS SEEN IN THE CLINIC AND FELT WELL.\nTHERE WAS NO PAIN IN\nTHE KNEE.", True),
        ("Die Patientin klagte über Schmerzen im Rücken seit 40 Tagen. Er konnte nach der Übung gehen.", True),
        ("Plan:\nThe patient was sent home with advice and will be seen again in a week.\n- aspirin 5 mg\n- iron 2 mg", True),
        ("- aspirin 5 mg PO daily\n- iron 2 mg PO weekly\n- insulin 3 mg SC q8h", False),
        ("|a|b|\n|---|---|\n|1|2|\n|3|4|", False),
        ("sodium 3 4 H\npotassium 5 6 L", False),
        ("qwrt zxcv bnmk plkj hgfd", False),
        ("stray fragment", False),
    ],
)
def test_prose(text, prose):
    assert quality.describe(text)[-1] is prose


@pytest.mark.parametrize(
    "text,prose",
    [
        ("\n".join(f"- {x} was given in the morning." for x in ("Aspirin", "Iron", "Insulin", "Zinc")), False),
        ("\n".join(f"{i}\t{x}\tHe was told to take it with food." for i, x in enumerate(("iron", "zinc", "salt"))), False),
        ("\n".join(f"{x},{i},it was given to him in the morning" for i, x in enumerate(("iron", "zinc", "salt"))), False),
        ("\n".join(f"{x:<12}He was told to take it with food." for x in ("iron", "zinc", "salt", "selenium")), False),
        ("\n".join(f"Knee:\n  It was sore in the morning.\n  There was no rash on day {i}." for i in range(5)), False),
        ("- ацетилсалициловая кислота\n- железо внутрь утром\n- инсулин перед едой вечером", False),
        ("アスピリンを朝に服用\n鉄剤を夕方に服用\nインスリンを毎食前に", False),
        ("Больной был осмотрен утром и чувствовал себя хорошо. Болей в колене\nне было, и он ушел домой.", True),
        ("\n".join(f"{i}. The knee was sore on the first day. It was better when he left, and he was glad." for i in range(4)), True),
        ("He was seen in the clinic, and he felt well on the whole day. There was no pain in the knee.\n- iron 5 mg\n- zinc 2 mg\n- salt 3 mg", True),
        ("  The man was seen in the\nclinic and he felt well on\nthat day.\n" * 4, True),
    ],
)
def test_layout_decides_with_sentences(text, prose):
    assert quality.describe(text)[-1] is prose


WORDY = ["Knee pain", "It was sore", "He felt well", "No rash seen", "She slept badly", "The arm was dry"]


@pytest.mark.parametrize(
    "text,prose",
    [
        ("\n".join(f"{WORDY[i % 6]} today;{WORDY[(i + 1) % 6]} at night;{WORDY[(i + 2) % 6]} since then." for i in range(12)), False),
        ("\n".join(f"{WORDY[i % 6]} today,{WORDY[(i + 1) % 6]} at night,{WORDY[(i + 2) % 6]} since then." for i in range(12)), False),
        ("\n".join(f"{WORDY[i % 6]:<20}{WORDY[(i + 1) % 6]:<20}{WORDY[(i + 2) % 6]}." for i in range(12)), False),
        ("\n".join(f"Iron tablets {i + 1} mg in the morning." for i in range(6)), False),
        ("Pacjentka zgłosiła się do przychodni z powodu bólu kolana. Badanie nie wykazało obrzęku. Zalecono odpoczynek i kontrolę za tydzień.", True),
        ("Potilas tuli vastaanotolle polvikivun vuoksi. Tutkimuksessa ei todettu turvotusta. Kontrolli sovittiin viikon päähän.", True),
        ("Hasta diz ağrısı nedeniyle polikliniğe başvurdu. Muayenede şişlik saptanmadı. Bir hafta sonra kontrol önerildi.", True),
        ("Patienten kom till mottagningen på grund av knäsmärta. Undersökningen visade ingen svullnad. Återbesök om en vecka planerades.", True),
        ("Patient admitted overnight. Symptoms resolved quickly following treatment. Discharged home stable without further complaints.", True),
        ("Lumbar puncture performed yesterday evening. Cultures remained negative throughout. Antibiotics stopped.", True),
        ("Praocaine 2.5 mg.\nGanitide 40 mg.\nOsiuromab 50 mg.\nMonuromab 25 mg.", False),
        ("heart, spleen, groin, liver, sodium, albumin, flank, urea, scalp, sinus, trachea, chloride.", False),
        ("Ab3kf93kdla9 s93kdkfie83 dk39fka93kd 39dkfkalw93 kdi39fkal3 d93kfk.", False),
        ("heart spleen groin liver sodium albumin flank urea scalp sinus trachea chloride heart spleen", False),
    ],
)
def test_prose_in_any_language_and_tables_of_words(text, prose):
    assert quality.describe(text)[-1] is prose


def test_statistics_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "k long, t string, word_count int")
    rows = {r["k"]: r for r in quality.text_statistics(df, "k", "t").collect()}
    assert len(rows) == len(ODD)
    for i in (0, 1, 2, 3, 8, 10):
        assert rows[i]["word_count"] == 0 and rows[i]["is_prose"] is None and rows[i]["prose_share"] is None
    assert sorted(r["k"] for r in quality.not_prose(df, "k", "t").collect()) == [4, 5, 6, 7, 9]
    assert quality.text_statistics(df.where("k < 0"), "k", "t").count() == 0


def test_grades_order_and_ignore_what_is_no_sentence(spark):
    easy = "You can eat and sleep at home. Call us if it hurts. Keep the arm dry."
    hard = (
        "Notwithstanding the endocrinological considerations enumerated above, the persistence of immunosuppressive coagulopathy "
        "corroborated multidisciplinary deliberation regarding the comparative appropriateness of continued administration."
    )
    listed = "Medications:\n- immunosuppressive pharmacotherapy 5 mg\nGLUCOSE-5.1* HEMOGLOBIN-3.2\n____\n"
    assert readability.grade(easy)[2] < 5 < 14 < readability.grade(hard)[2]
    assert readability.grade(listed + easy) == readability.grade(easy)
    assert readability.grade(listed)[2] is None
    df = spark.createDataFrame([("a", easy, 1.0), ("b", hard, 1.0), ("b", hard, 1.0), *[(f"x{i}", t, 1.0) for i, t in enumerate(ODD)]], "n string, t string, grade double")
    assert [r["n"] for r in readability.demanding_texts(df, "n", "t").collect()] == ["b"]


SPOKEN = {
    1: "cat made walked makes the he through strength eye are were one goes played friend field piece chief blue true guess build fruit juice",
    2: "table running create science lion cafe café react handled boxes needed safely patient ocean million union being going doing chaos poem fluid quiet "
    "client language people surgeon rhythm business carried studied saying beyond lawyer lately hopeful careless social special region cautious cruel influx player",
    3: "hospital recipe simile area idea radius medium previous animal management actual gradual video continue family element beautiful clinician influence "
    "dementia syncope catheter suicide fluoride",
    4: "experience information operation diagnosis particular material evaluate abdominal ordinary diabetes cyanosis well-established",
    5: "myocardial administration consideration",
    6: "responsibility rehabilitation",
}


@pytest.mark.parametrize("count", SPOKEN)
def test_syllables_by_patterns(count):
    assert [w for w in SPOKEN[count].split() if syllables.syllables(w) != count] == []


def test_grades_are_not_clamped():
    assert readability.grade("Go on. Do it. He is in. It is so. " * 2, readability.GradeRule(least_words=2))[2] < 0
    long = " ".join(["notwithstanding", "immunosuppressive", "considerations"] * 40) + "."
    assert readability.grade(long)[2] > 40


# p5


@pytest.mark.parametrize("rule", [splitter.SplitRule(40, 7), splitter.SplitRule(50, 9, "characters"), splitter.SplitRule(5, 4), splitter.SplitRule(3, 0, "characters")])
def test_pieces_lose_nothing_and_overlap_exactly(rule):
    rng = random.Random(4)
    parts = ["a", "bb", " ", "\n", "\n\n", ". ", "Head:\n", "- x ", "\r\n", "é" * 30, "\t", "🎉", "1. y\n"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 200)))
        pieces = splitter.split(text, rule)
        ruler = splitter._Ruler(text, rule.unit)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert len(pieces) == 1 or all(ruler.size(*p) <= rule.limit for p in pieces)
        assert (len(pieces) > 1) == (ruler.size(0, len(text)) > rule.limit)
        for (a, b), (c, e) in zip(pieces, pieces[1:]):
            assert a <= c <= b < e and ruler.size(c, b) == rule.overlap


def test_cuts_follow_the_structure():
    text = "Head:\n" + "one two three. " * 10 + "\n\nNext:\n" + "four five six. " * 10
    (_, first), (second, _) = splitter.split(text, splitter.SplitRule(40, 0))
    assert first == second == text.index("Next:")


def test_pieces_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "k long, t string, piece string")
    found = {}
    for r in splitter.split_column(df, "k", "t", splitter.SplitRule(100, 10, "characters")).collect():
        found.setdefault(r["k"], []).append(r)
    assert sorted(found) == [2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert len(found[6]) == found[6][0]["n_pieces"] == 556
    counts = splitter.piece_counts(df, "k", "t", splitter.SplitRule(100, 10, "characters")).collect()
    assert {r["k"]: r["n_pieces"] for r in counts} == {i: len(found.get(i, [])) for i in range(len(ODD))}


# p6


def nearest(rows, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    out = set()
    for i, u in unit.items():
        near = sorted((round(-float(u @ w), 9), j) for j, w in unit.items() if j != i)[:k]
        out |= {(i, j) for _, j in near}
    return out


def test_neighbours_equal_brute_force_on_few_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, [2 * x for x in rows[i][1]]) for i in range(8)] + [(200 + i, rows[0][1]) for i in range(9)]
    odd = [(300, None), (301, [0.0] * 6), (302, [1.0, 2.0]), (303, [float("nan")] * 6), (None, [1.0] * 6), rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *odd]], "k long, v array<float>, neighbour string")
    found = vectors.nearest(df, "k", "v", 5)
    assert {(r["k"], r["neighbour"]) for r in found.collect()} == nearest([(i, np.float32(v).astype(float)) for i, v in rows], 5)
    assert vectors.nearest(df.where("k is null"), "k", "v").count() == 0
    assert {(r["k"], r["reason"]) for r in vectors.skipped(df, "k", "v").collect()} == {
        (300, "null_vector"), (301, "zeros"), (302, "other_length"), (303, "not_finite"), (None, "null_key"),
    }


def test_learned_parts_reach_their_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 16))
    rows = [(i, (centres[i % 150] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1800)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    rule = vectors.IndexRule(part_size=200, sample=900, block=150)
    found = {(r["k"], r["neighbour"]) for r in vectors.nearest(df, "k", "v", 5, rule).select("k", "neighbour").collect()}
    want = nearest([(i, np.float32(v).astype(float)) for i, v in rows], 5)
    assert len(found) == len(want)
    assert len(found & want) / len(want) >= 0.9


def test_parts_of_parts_reach_their_recall_and_keep_their_size(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16))
    rows = [(i, (centres[i % 200] + 0.3 * rng.normal(size=16)).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    rule = vectors.IndexRule(part_size=60, most_parts=6, sample=1200, block=90)
    found = {(r["k"], r["neighbour"]) for r in vectors.nearest(df, "k", "v", 5, rule).select("k", "neighbour").collect()}
    want = nearest([(i, np.float32(v).astype(float)) for i, v in rows], 5)
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.9
    same = spark.createDataFrame([(i, [1.0 + 1e-6 * (i % 7), float(i % 3 == 0)]) for i in range(300)], "k long, v array<float>")
    assert vectors.nearest(same, "k", "v", 2, vectors.IndexRule(part_size=10, most_parts=3, sample=60, block=40)).count() == 600


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(500, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    part = vectors.balanced_parts(vectors.neighbour_graph(unit, 8), 7, 1)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1.1 * 500 / 7)


# p2, p1


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.9])
def test_set_join_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    sets = lambda n: [(i, sorted(set(rng.choices("abcdefghij", k=rng.randint(0, 6))))) for i in range(n)]
    left, right = sets(60), sets(40)
    a, b = spark.createDataFrame(left, "left_id long, items array<string>"), spark.createDataFrame(right, "right_id long, items array<string>")
    found = {(r["left_id"], r["right_id"]) for r in setjoin.best_matches(a, b, threshold, keep=None).collect()}
    want = {(i, j) for i, x in left for j, y in right if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= threshold}
    assert found == want
    best = {r["left_id"]: r["right_id"] for r in setjoin.best_matches(a, b, threshold).collect()}
    score = lambda i, j: len({*left[i][1]} & {*right[j][1]}) / len({*left[i][1]} | {*right[j][1]})
    assert best == {i: min((j for k, j in want if k == i), key=lambda j: (-score(i, j), j)) for i in {i for i, _ in want}}


def test_edits_count_swaps_once():
    pairs = [("abc", "abc"), ("acb", "abc"), ("ab", "abc"), ("xbc", "abc"), ("cab", "abc"), ("abcdef", "a")]
    assert [terms.edits(a, b, 2) for a, b in pairs] == [0, 1, 1, 1, 2, 3]


LIST = [
    (1, "knee pain", "patella ache | knee ache"), (2, "pain of the Hip", "hip ache"), (3, "knee swelling", None), (4, "hip dislocation", "hip out of joint"),
    (5, "elbow dislocation", "elbow out of joint"), (6, "tailbone pain", "coccyx pain"), (7, "tailbone swelling", "coccyx swelling"), (8, "", None), (9, None, "x"),
]
SAID = ["knee pain", "left kene pain since monday", "ache of the hip", "hip out of joint", "coccyx swelling after golf", "elbow pain", "swelling of the hip", "", None, "?"]


@pytest.fixture()
def tables(spark):
    reference = spark.createDataFrame([(*r, "q") for r in LIST], "ref_id long, preferred_term string, entry_terms string, text string")
    said = spark.createDataFrame([(t, i) for i, t in enumerate(SAID)] + [(SAID[0], 0)] * 3, "said string, ref_id long")
    return said, reference


def test_values_find_their_entries(tables):
    said, reference = tables
    found = {r["said"]: r["ref_id"] for r in canonical.map_to_list(said, "said", reference).collect()}
    assert found == dict(zip([s for s in SAID if s is not None], [1, 1, 2, 4, 7, None, None, None, None]))
    assert canonical.map_to_list(said.where("false"), "said", reference).count() == 0
    assert {r["ref_id"] for r in canonical.map_to_list(said, "said", reference.where("false")).collect()} == {None}


def test_records_of_one_story_share_a_cluster(spark, tables):
    stories = [
        ["knee pain since monday after golf with fever", "left ache of the knee after golf since monday and fever", "kene pain since monday with fever", "also fever right knee ache while golf"],
        ["knee pain since friday during rowing with nausea", "knee ache and nausea since friday post rowing"],
        ["hip out of joint today associated fever", "dislocation of the hip today also fever"],
    ]
    rows = [(100 * i + j, t, "x") for i, texts in enumerate(stories) for j, t in enumerate(texts)]
    rows += [(901, None, ""), (902, "", ""), (None, "knee pain", ""), rows[0]]
    df = spark.createDataFrame(rows, "k long, t string, cluster string")
    found = clusters.cluster_stories(df, "k", "t", tables[1])
    pairs = {(r["k_a"], r["k_b"]) for r in clusters.same_cluster_pairs(found, "k").collect()}
    assert pairs == {(100 * i + a, 100 * i + b) for i, texts in enumerate(stories) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    told = clusters.describe_clusters(found, df, "k", "t").collect()
    assert sorted(r["size"] for r in told) == [2, 2, 4] and all(1 <= len(r["typical"]) <= 3 for r in told)
    assert clusters.cluster_stories(df.where("k > 900"), "k", "t", tables[1]).count() == 0


def test_a_record_with_several_complaints_has_all_of_them(spark, tables):
    knee, hip = ["knee pain since monday after golf", "left knee ache since monday after golf"], ["hip out of joint today with fever", "dislocation of the hip today with fever"]
    rows = [(1, knee[0]), (2, knee[1]), (3, hip[0]), (4, hip[1]), (5, knee[0]), (5, hip[1]), (6, knee[1]), (6, knee[0]), (6, hip[0]), (6, None), (5, hip[1])]
    df = spark.createDataFrame(rows, "k long, t string")
    found = clusters.cluster_stories(df, "k", "t", tables[1])
    pairs = [(r["k_a"], r["k_b"]) for r in clusters.same_cluster_pairs(found, "k").collect()]
    one, other = [1, 2, 5, 6], [3, 4, 5, 6]
    assert sorted(pairs) == sorted({(a, b) for members in (one, other) for a in members for b in members if a < b})
    told = {r["typical"][0].split()[-1]: (r["size"], sorted(r["typical"])) for r in clusters.describe_clusters(found, df, "k", "t").collect()}
    assert told == {"golf": (4, sorted(knee)), "fever": (4, sorted(hip))}


def test_words_meet_over_what_is_left_of_them(spark):
    words = {"during": 400, "surfing": 24, "surfnig": 1, "surffing": 1, "dring": 2, "knee": 50, "kene": 3, "knees": 2, "xq": 1, "dislocation": 5, "dilsocatoin": 1}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r["word"]: r["right"] for r in terms.spelling(counts, spark.createDataFrame([("knee",), ("dislocation",)], "word string")).collect()}
    assert found == {"surfnig": "surfing", "surffing": "surfing", "dring": "during", "kene": "knee", "knees": "knee", "dilsocatoin": "dislocation"}
    assert terms.spelling(counts.where("false"), counts.where("false").select("word")).count() == 0


def test_synonyms_are_joined_by_phrase(spark):
    rows = [(1, "pain low back of the out of joint hip".split()), (2, ["knee"]), (3, [])]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    meanings = spark.createDataFrame([("low back", ["lumbar"]), ("back", ["spine"]), ("out joint", ["dislocation"]), ("hip", ["hip", "joint"])], "phrase string, means array<string>")
    found = {r["k"]: r["w"] for r in terms.preferred(df, "k", "w", meanings).collect()}
    assert found == {1: "pain lumbar of the dislocation hip joint".split(), 2: ["knee"], 3: []}


def test_cells_and_seeds_do_not_grow_with_the_records(spark):
    rule = clusters.ClusterRule(k=16)
    for n in (300, 3000):
        parts = spark.range(n).selectExpr("cast(id as string) as point", "array(concat('head:s', id % 40), concat('head:t', id div 40), concat('onset:o', id % 7)) as parts", "1L as weight")
        heads = clusters.head_vectors(parts, rule)
        cells = clusters.head_cells(heads, rule).toPandas()
        assert len(cells) == heads.count() and cells["cell"].nunique() <= 16
    assert clusters.head_cells(heads.where("false"), rule).count() == 0


def test_clusters_are_the_stories(spark):
    rng = random.Random(8)
    points, story = [], {}
    for i in range(120):
        whole = [f"company:c{rng.randint(0, 9)}", f"head:s{i % 12}", f"head:t{i % 5}", f"occasion:a{rng.randint(0, 20)}", f"onset:o{rng.randint(0, 20)}"]
        for j in range(4):
            parts = whole if j == 0 else [x for x in whole if not x.startswith(("company", "occasion", "onset")[j - 1])]
            points.append(("|".join(parts), parts, 9 if j == 0 else 1))
            story.setdefault("|".join(parts), set()).add("|".join(whole))
    df = spark.createDataFrame(sorted({p[0]: p for p in points}.values()), "point string, parts array<string>, weight long")
    rule = clusters.ClusterRule()
    rows = clusters.features(df, rule).join(df.select("point", "parts"), "point").toPandas()
    own, cosine = clusters._story_clusters(rows, rule)
    name = rows["point"].to_numpy()
    plain = [i for i in range(len(rows)) if len(story[name[i]]) == 1]
    assert all(name[own[i]] in story[name[i]] for i in plain) and cosine.min() >= rule.least


def contents(stories, head_value=1.0):
    """A cell's rows of (parts, weight): a feature for the joint head and for each other part."""
    rows = []
    for parts, weight in stories:
        head, rest = "|".join(p for p in parts if p.startswith("head:")), [p for p in parts if not p.startswith("head:")]
        rows.append(("+".join(parts), zlib.crc32(head.encode()), weight, np.array([zlib.crc32(p.encode()) for p in [head, *rest]]), np.array([head_value] + [1.0] * len(rest)), parts))
    return pd.DataFrame(rows, columns=["point", "head", "weight", "features", "values", "parts"])


OCCASIONS = "archery baking camping dancing fishing gymnastics hammering juggling kayaking lacrosse meditation plumbing".split()


@pytest.mark.parametrize("copies", [1, 60])
def test_a_slip_meets_every_story_of_its_head(copies):
    said = lambda word: ["company:fever", "head:knee", "head:pain", f"occasion:{word}", "onset:dusk"]
    slips = {w[1] + w[0] + w[2:]: w for w in OCCASIONS}
    rows = contents([(said(w), 20 * copies) for w in OCCASIONS] + [(said(s), copies) for s in slips])
    rows = rows.sample(frac=1, random_state=3).reset_index(drop=True)
    own, cosine = clusters._story_clusters(rows, clusters.ClusterRule())
    found = {p[3][9:]: rows["parts"][i][3][9:] for p, i in zip(rows["parts"], own)}
    assert found == {w: w for w in OCCASIONS} | slips and len(cosine) == len(rows)


def test_what_is_no_slip_or_not_rarer_stays():
    said = lambda word: ["company:fever", "head:knee", "head:pain", f"occasion:{word}", "onset:dusk"]
    rows = contents([(said("hiking"), 30), (said("biking"), 20), (said("roofing"), 1), (said("hikign"), 2), (said("hikig"), 1)])
    own, _ = clusters._story_clusters(rows, clusters.ClusterRule())
    assert own.tolist() == [0, 1, 2, 0, 0]
    assert clusters._story_clusters(rows[2:3].reset_index(drop=True), clusters.ClusterRule())[0].tolist() == [0]


def test_clusters_do_not_depend_on_the_cells():
    rest = ["company:fever", "occasion:golf", "onset:dusk"]
    stories = [([rest[0], f"head:s{i}", "head:t", *rest[1:]], 5) for i in range(6)] + [([rest[0], f"head:s{i}", "head:t", rest[2]], 2) for i in range(6)]
    rows = contents(stories, head_value=0.5)
    rule = clusters.ClusterRule()
    whole = [rows["point"][i] for i in clusters._story_clusters(rows, rule)[0]]
    cut = {}
    for _, cell in rows.groupby(rows["head"] % 3):
        cell = cell.reset_index(drop=True)
        cut |= {p: cell["point"][i] for p, i in zip(cell["point"], clusters._story_clusters(cell, rule)[0])}
    assert whole == [cut[p] for p in rows["point"]] == [rows["point"][i % 6] for i in range(12)]


def test_pairs_of_large_clusters_come_in_blocks(spark):
    df = spark.range(50).selectExpr("id as k", "'c' as cluster", "3000L as size")
    assert clusters.same_cluster_pairs(df, "k").count() == 50 * 49 // 2
