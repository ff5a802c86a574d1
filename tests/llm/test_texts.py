"""Problems 5, 6 and 7."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from molquarry.llm import mixing, packing, queries, stuffing, tokens

DOCS = "doc_id bigint, text string, source string, tokens int"


def fewest(sizes, capacity):
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in tried:
                tried.add(bins[k])
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_sound_and_best_on_small_sets():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 20, 50, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        bins = packing.complete(dict(Counter(sizes)), capacity)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        assert packing.lower_bound(Counter(sizes), capacity) <= fewest(sizes, capacity) == len(bins)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ring", "mole", "acid", "the"]) for _ in range(rng.randint(1, 60))), rng.choice("ab"), 0) for i in range(300)]
    rows += [(900, "acid " * 500, "a", 0), (901, None, "a", 0), (902, "", "a", 0), (903, " ", "b", 0), (904, "x", None, 0), (904, "x", None, 0)]
    return spark.createDataFrame(rows, DOCS)


def test_packing(spark, docs):
    kinds = spark.createDataFrame([(1, 64), (2, 100), (3, None), (4, 0)], "container_id int, capacity int")
    for block in (8192, 40):
        packed = packing.pack_documents(docs, kinds, block=block).collect()
        size = {r["doc_id"]: r["tokens"] for r in tokens.token_sizes(docs, "doc_id").collect()}
        for k, cap in ((1, 64), (2, 100)):
            own = [r for r in packed if r["container_id"] == k]
            total, room = Counter(), defaultdict(int)
            for r in own:
                total[r["doc_id"], r["copy"]] += r["tokens"]
                room[r["block"], r["slot"] if r["block"] >= 0 else (r["doc_id"], r["copy"], r["piece"])] += r["tokens"]
            assert {d: n for (d, _), n in total.items()} == size and total[904, 1] == 1
            assert max(room.values()) <= cap and all(len([1 for r in own if r["doc_id"] == d]) == -(-n // cap) for d, n in size.items() if d != 904)
            if block == 8192:
                assert len(room) <= -(-sum(total.values()) // cap) + 1
    pieces = packing.pack_documents(docs, kinds.where("container_id = 2"))
    assert [r["doc_id"] for r in packing.divided(pieces).collect()] == [900]
    report = packing.fill_report(pieces).first()
    assert report["tokens"] == sum(size.values()) + 1 and 0 <= report["unused"] < 0.1
    assert packing.pack_documents(docs.where("false"), kinds).count() == 0


def test_divided_pages_of_the_tables(spark, small):
    cap = max(r["capacity"] for r in spark.read.parquet(f"{small}/containers.parquet").collect())
    encode = tokens.tokenizer().encode_ordinary
    want = {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect() if len(encode(r["text"])) > cap}
    assert {r["doc_id"] for r in queries.p5_found(spark, small).collect()} == want


def test_rank_tokenizer_equals_the_library_model():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("", " ", "a  b\n\nc ", "don't 12345 <|endoftext|>", "Größe é​ ｆ", "c1(CC)ncc(C)cc1" * 50):
        assert tokens.tokenizer().encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_mixes(spark, docs):
    mixes = spark.createDataFrame([(1, 3000), (2, 100000)], "mix_id int, total_tokens bigint")
    targets = spark.createDataFrame(
        [(1, "a", 0.5, 3), (1, "b", 0.5, 3), (2, "a", 0.1, 4), (2, "b", 0.8, 2), (2, "zz", 0.1, 5), (1, "zero", 0.0, 1)], "mix_id int, source string, weight double, max_repeat int"
    )
    taken, plan = mixing.sample_mix(docs, mixes, targets)
    taken.cache()
    pool = Counter()
    for r in tokens.token_sizes(docs, "source").collect():
        pool[r["source"]] += r["tokens"]
    report = {(r["mix_id"], r["source"]): r for r in mixing.mix_report(taken, plan).collect()}
    for (m, s), r in report.items():
        most = targets.where((F.col("mix_id") == m) & (F.col("source") == s)).first()["max_repeat"]
        assert r["unmet"] == (r["wanted"] > most * pool[s]) and r["most_copies"] <= most
        if r["unmet"]:
            assert r["actual"] == most * pool[s]
        else:
            assert abs(r["actual"] - r["wanted"]) <= 0.05 * r["wanted"] + 60
    assert {k for k, r in report.items() if r["unmet"]} == {(r["mix_id"], r["source"]) for r in plan.where("unmet").collect()} == {(2, "b"), (2, "zz")}
    again, _ = mixing.sample_mix(docs.repartition(5), mixes, targets)
    assert again.exceptAll(taken).count() == 0
    none, _ = mixing.sample_mix(docs.where("false"), mixes, targets)
    assert none.count() == 0


def repeated_by_force(s, sizes, letters, least, times, least_letters):
    n = len(s)
    hit = [False] * n
    for i in range(n):
        for j in range(i + 1, n + 1):
            found = sum(s[k : k + j - i] == s[i:j] for k in range(n - (j - i) + 1))
            if found >= times and found * sum(sizes[i:j]) >= least and sum(letters[i:j]) >= least_letters:
                hit[i:j] = [True] * (j - i)
    return hit


def test_automaton_against_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 18))]
        size_of, letters_of = [rng.randint(1, 4) for _ in range(10)], [rng.randint(0, 2) for _ in range(10)]
        rule = (rng.choice([1, 6, 12]), rng.choice([2, 3]), rng.choice([1, 3]))
        sizes, letters = [size_of[c] for c in s], [letters_of[c] for c in s]
        assert stuffing.repeated(s, sizes, letters, *rule) == repeated_by_force(s, sizes, letters, *rule)


PROSE = "The sample was dried before noon. Nobody could say why the value rose after the second reading. We wrote it down and went home. "
SPAM = [
    "buy kit | cheap kit | fast order | " * 12, "#sale #buy #sale #order " * 10, "https://a.example/x?id=1\nhttps://b.example/y\n" * 8,
    '<a href="https://a.example/buy">Cheap Kit</a>\n' * 8, "Xalotan - 12.50<br>Mirabol - 8.10<br>Toruvan - 77.00<br>" * 3, "offer for order the fast and shop. " * 10,
    "Reagenz kaufen Ditistadt Reagenz Preis Moberg " * 9, "lot: dry • size: 5g • brand: XL • " * 8, PROSE + "\n" + "kit bulk sale order " * 30, '<meta name="keywords" content="kit sale kit">' * 3,
]
CLEAN = [
    PROSE * 3, PROSE + "\nTags: #kit, #sale, #order", "smiles,mw\n" + "c1(CCSC)ncc(C)cc1,199.45\n" * 9, "INFO row=1 prop=mw ok\n" * 20,
    "user: Donor count, c1ccccc1?\nassistant: {\"tool\": \"property\"}\ntool: {\"result\": 1}\n" * 6, "1. Stir for 5 minutes.\n2. Stop when the colour fades.\n3. Note the mass in the book.\n" * 3,
    "ring count: We looked at the number twice.\nlogP: This is how greasy it is.\n", "L'échantillon froid restait clair, l'autre s'est troublé. " * 2, PROSE + "See https://a.example/b for the details.", "",
]


def test_stuffed_and_clean_pages(spark):
    rows = [(i, t, None, 0) for i, t in enumerate(SPAM + CLEAN)] + [(100, None, "s", 1), (101, "  \n", "s", 1), (3, SPAM[3], "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert Counter(r["doc_id"] for r in stuffing.stuffed_pages(df).collect()) == Counter([*range(len(SPAM)), 3])
    whole = stuffing.measure_pages(df).where(F.col("covered") > 0.5 * F.col("chars"))
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter([*range(len(SPAM)), 3])
    assert stuffing.stuffed_pages(df.where("false")).count() == 0


FOREIGN = [
    "Wczoraj rano pojechaliśmy do małego miasteczka nad rzeką, gdzie mieszka moja ciotka. Pogoda była piękna, więc po śniadaniu poszliśmy na spacer "
    "wzdłuż brzegu i rozmawialiśmy o dawnych czasach. Ciotka opowiadała, jak w młodości pracowała w laboratorium i badała nowe związki.",
    "Вчера утром мы поехали в небольшой город у реки, где живёт моя тётя. Погода была прекрасная, поэтому мы пошли гулять вдоль берега и говорили "
    "о прежних временах. Тётя рассказывала, как в молодости работала в лаборатории и изучала новые соединения.",
    "昨日の朝、私たちは叔母が住んでいる川沿いの小さな町へ出かけました。天気がとても良かったので、朝食の後に岸辺を散歩しながら昔の話をしました。",
    "Gisteren reden we naar een klein stadje aan de rivier, waar mijn tante woont. Het weer was prachtig, dus gingen we wandelen langs de oever.",
    "Ieri mattina siamo andati in una piccola città lungo il fiume, dove abita mia zia. Il tempo era bellissimo, così abbiamo passeggiato sulla riva.",
    "Inventory\n" + "\n".join("aspirin caffeine toluene benzene phenol aniline pyridine furan thiophene indole quinoline glucose ribose".split()),
]


def test_only_repetition_tells_keywords_from_prose_of_unlisted_languages(monkeypatch):
    """Neither has listed function words, so the automaton decides."""
    stuffed = ["tani odczynnik, sklep, tani sklep, odczynnik, " * 6, "安い試薬、試薬販売、安い試薬、試薬卸売、" * 6, "купить реактив | реактив | " * 8]
    for text in FOREIGN + stuffed:
        chars, bare, _ = stuffing.measure(text)
        assert bare > 0.5 * chars or text in FOREIGN[3:5]
    assert [stuffing.is_stuffed(t) for t in FOREIGN + stuffed] == [False] * len(FOREIGN) + [True] * 3
    monkeypatch.setattr(stuffing, "repeated", lambda symbols, *_: [True] * len(symbols))
    assert all(stuffing.is_stuffed(t) for t in [*FOREIGN[:3], FOREIGN[5]])
    monkeypatch.setattr(stuffing, "repeated", lambda symbols, *_: [False] * len(symbols))
    assert not any(stuffing.is_stuffed(t) for t in stuffed)


def test_long_page_takes_linear_time():
    import time

    began = time.time()
    chars, bare, covered = stuffing.measure("cheap kit order " * 60000)
    assert bare == chars and covered == chars and time.time() - began < 30
