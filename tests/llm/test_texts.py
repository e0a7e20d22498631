import hashlib
import math
import random
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ranklore.llm import language_id as LID
from ranklore.llm import media_store as MS
from ranklore.llm import piece_bpe as P
from ranklore.llm import quality as QL
from ranklore.llm import token_counts as T
from ranklore.llm import toxicity as TX
from ranklore.llm._folds import fold, texts_of
from tests_paths import tokenizer_path


@pytest.fixture(scope="module")
def pieces():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return P.piece_table(f.read())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_merge_rounds_against_library(pieces, library):
    rnd = random.Random(7)
    parts = ["a", "e", "th", "=", "--", " ", "  ", "\n", "é", "中", "😀", "▁", "ing", "0", ".", "\t", "\0", "<0x0A>", "</s>", "er"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) * rnd.choice([1, 1, 2, 3, 9]) for _ in range(rnd.randint(0, 25)))
        assert pieces.encode_text(text) == library.encode(text), text
        assert pieces.decode(library.encode(text)) == library.decode(library.encode(text)), text
    for n in (*range(100), 1000, 4097):
        for text in (" " * n, " " * n + "end", "x" + " " * n + "="):
            assert pieces.encode_text(text) == library.encode(text), (n, text[-4:])


def test_long_words_against_library(pieces, library):
    """Texts without blanks: cuts that no piece spans, noisy merges, and time in proportion to the length."""
    rnd = random.Random(11)
    alphabets = ("etaoinsr", "abcdefghijklmnopqrstuvwxyz", "=-_*#", "aeiou0123456789", "AbC+/=中é😀")
    for n in (65, 200, 3000):
        for letters in alphabets:
            for _ in range(12):
                text = "".join(rnd.choice(letters) for _ in range(n))
                assert pieces.encode_text(text) == library.encode(text), text[:80]
                assert "".join(pieces.cuts(text)) == text
    sly = [library.id_to_piece(int(i)) for i in np.flatnonzero(pieces.unsafe[: len(pieces.rank)])]
    sly = [p for p in sly if P.BLANK not in p]
    for _ in range(150):
        text = "".join(rnd.choice(sly) for _ in range(rnd.randint(2, 120)))
        assert pieces.encode_text(text) == library.encode(text), text[:80]
    for unit in ("x", "the", "ab", "=", "-", "ing", "0", "中", "erin"):
        text = unit * 3333
        assert pieces.encode_text(text) == library.encode(text), unit
    seconds = {}
    for n in (100_000, 400_000):
        text = "".join(rnd.choice(alphabets[1] + alphabets[4]) for _ in range(n))
        begun = time.perf_counter()
        mine = pieces.encode_text(text)
        seconds[n] = time.perf_counter() - begun
        assert mine == library.encode(text)
    assert seconds[400_000] < 12 * seconds[100_000] + 1  # a quadratic one would take 16 times as long


def test_store_is_bounded_and_right(pieces):
    store, small = P.WordStore(pieces, 1000), P.WordStore(pieces, 5)
    words = [f"w{i % 37}" for i in range(500)]
    a, b = store.encode(words), small.encode(words[:5])
    assert a[1].sum() == len(a[0]) and len(small.index) <= 5 and (a[0][: len(b[0])] == b[0]).all()
    assert len(small.encode([f"v{i}" for i in range(9)])[1]) == 9


def test_encode_pieces(hard, clashing, empty, library):
    path = tokenizer_path("piece_bpe_32k.model")
    want = sorted(
        (str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        for r in hard.collect()
        for ids in [library.encode(r["text"] or "")]
    )
    for docs in (hard, clashing):
        got = P.encode_pieces(docs, path, with_ids=True).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
        assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert P.encode_pieces(empty, path).count() == 0


def test_token_counts(hard, clashing, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        tokenizer = T.load_tokenizer(f.read())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in hard.collect())
    for docs in (hard, clashing):
        got = T.token_counts(docs, path, chunk=700, overlap=16).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert T.token_counts(empty, path).count() == 0


def test_splicing_at_stable_boundaries():
    with open(tokenizer_path("byte_bpe_50k.json"), "rb") as f:
        tokenizer = T.load_tokenizer(f.read())
    rnd = random.Random(3)
    parts = ["word", " ", "  ", "\n\n", "'s", "don't", "123", "!!!", "<|endoftext|>", "é", "中文", "a" * 60, " " * 40, "x", "\t", "😀"]
    widened = 0
    for _ in range(250):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(20, 150)))
        counter = T.ChunkedCounter(tokenizer, rnd.choice([40, 64, 100]), rnd.choice([1, 8, 20]))
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
        widened += counter.widened
    assert widened > 0
    for text in ("b" * 5000, " " * 5000, "<|endoftext|>" * 300):
        assert T.ChunkedCounter(tokenizer, 100, 10).count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        T.ChunkedCounter(tokenizer, 10, 10)


def test_media_round_trip(spark, hard, clashing, empty, tmp_path):
    for docs in (hard, clashing):
        store = MS.MediaStore(spark, f"file://{tmp_path}/{id(docs)}", shard_bytes=20_000)
        index = store.store(docs)
        rows = store.with_features(store.with_metadata(index)).collect()
        assert len(rows) == 16
        texts = {}
        for r in hard.collect():
            raw = (r["text"] or "").encode()
            payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            texts.setdefault(hashlib.sha256(payload).hexdigest(), (len(raw), payload))
        for r in rows:
            payload = texts[r["payload_sha256"]][1]
            assert r["digest"] == r["payload_sha256"] and r["payload_bytes"] == len(payload) == r["width"] * r["height"]
            assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and (r["bit_depth"], r["colour_type"]) == (8, 0)
        same = {}
        for r in rows:
            same.setdefault(r["digest"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
        assert all(len(v) == 1 for v in same.values()) and set(same) == set(texts)
        names = {r["shard"] for r in rows}
        assert len(names) > 1
        for name in names:
            for member, data in MS.read_member((tmp_path / str(id(docs)) / "shards" / name).read_bytes()):
                assert hashlib.sha256(MS.PngCodec.decode(data)).hexdigest() + ".png" == member
    none = MS.MediaStore(spark, f"file://{tmp_path}/none")
    assert none.with_features(none.with_metadata(none.store(empty))).count() == 0


def test_media_is_addressed_by_content(spark, tmp_path):
    """One place a digest over tasks and calls; a compacted store holds each payload once."""
    rows = [(i, f"payload {i % 7} " * (i % 7 + 1)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    store = MS.MediaStore(spark, f"file://{tmp_path}/store", shard_bytes=4000)
    first = store.store(docs).collect()
    more = store.store(spark.createDataFrame([(900, rows[3][1]), (901, "new")], docs.schema)).collect()
    places = {}
    for r in [*first, *more]:
        places.setdefault(r["digest"], set()).add((r["shard"], r["offset"], r["length"]))
    assert len(places) == 8 and all(len(p) == 1 for p in places.values()) and len(first) == 200
    slim = store.compacted(f"file://{tmp_path}/slim")
    index = slim._indexes()
    told = {r["doc_id"]: r for r in slim.with_features(index).collect()}
    assert set(told) == {i for i, _ in rows} | {900, 901}
    for i, text in [*rows, (901, "new")]:
        assert told[i]["payload_sha256"] == hashlib.sha256(MS.padded(text.encode())).hexdigest()
    members = [m for f in (tmp_path / "slim" / "shards").iterdir() if f.suffix == ".tar" for m, _ in MS.read_member(f.read_bytes())]
    assert len(members) == len(set(members)) == 8


def test_media_features_against_plain(spark, hard, tmp_path):
    """Header values and features, sample by sample."""
    store = MS.MediaStore(spark, f"file://{tmp_path}/features")
    told = store.with_features(store.with_metadata(store.store(hard))).collect()
    rows = sorted((str(r["doc_id"]), r["text"] or "") for r in hard.collect())
    want = []
    for i, text in rows:
        payload = MS.padded(text.encode())
        mean = sum(payload) / len(payload)
        spread = math.sqrt(max(sum(b * b for b in payload) / len(payload) - mean * mean, 0.0))
        bands = [sum(b >> 5 == k for b in payload) for k in range(8)]
        feature = f"mean={mean:.4f};sd={spread:.4f};min={min(payload)};max={max(payload)};bands={','.join(map(str, bands))}"
        want.append((i, len(text.encode()), 192, len(payload) // 192, 8, 0, feature))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["width"], r["height"], r["bit_depth"], r["colour_type"], r["feature"]) for r in told) == sorted(want)


def test_png_is_checked():
    png = MS.PngCodec.encode(bytes(range(192)) * 2)
    assert MS.PngCodec.header(png[: MS.HEADER_BYTES]) == (192, 2, 8, 0)
    for bad in (b"x" * 50, png[:60] + b"\xff" + png[61:]):
        with pytest.raises((ValueError, zlib.error)):
            MS.PngCodec.decode(bad)


def plain_places(text):
    """n-grams of padded words, by slices."""
    folded = ""
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            folded += low
        else:
            folded += c if unicodedata.combining(c) and ord(c) < 0x3100 and folded[-1:] not in ("", " ") else " "
    out = []
    for word in folded.split():
        padded = f"\0{word}\0"
        for n in range(1, 5):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip("\0") == "" or (n > 2 and "\0" in gram[1:-1]):
                    continue
                h = 2166136261
                for c in gram:
                    h = (h ^ ord(c)) * 16777619 % 2**32
                    h ^= h >> 15
                out.append((h ^ (h >> 16)) & 0xFFFF)
    return sorted(out)


def test_ngrams_against_plain():
    texts = [" The cat, and 3 Ärzte!", "", "a", "x-y z", "!!!", "Éa b", "\u0301", "5\u0301 !\u0300", "\u0301"]
    places, sizes = LID.ngram_places(texts)
    for text, part in zip(texts, np.split(places, np.cumsum(sizes)[:-1]), strict=True):
        assert sorted(part.tolist()) == plain_places(text), text


def test_marks_are_no_letters(spark):
    """Combining marks belong to the letter before them; without one they are nothing."""
    assert LID.ngram_places(["\u0301", "3\u0301\u0300", " \u0301", "", "e\u0301", "\u0301e"])[1].astype(bool).tolist() == [False, False, False, False, True, True]
    one, other = LID.ngram_places(["e\u0301a", "ea"])[0], LID.ngram_places(["\u0301ea"])[0]
    assert len(one) > 2 * len(other) and sorted(LID.ngram_places(["\u0301ea"])[0]) == sorted(LID.ngram_places(["ea"])[0])
    docs = spark.createDataFrame([(1, "\u0301", "en"), (2, "12", "en"), *[(i, "some words", "en") for i in range(3, 9)]], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in LID.predict_languages(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0) and {got[i][0] for i in range(3, 9)} == {"en"}
    assert {r["doc_id"] for r in LID.drop_unidentified(docs).collect()} == set(range(3, 9))


def plain_profile(texts):
    counts = Counter(p for t in texts for p in plain_places(t))
    return [p for p, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))][: LID.PROFILE]


def test_language_predictions_against_plain(spark):
    """Sample, profiles, distances, ties and scores by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if len(r["text"] or "") < 3000]
    few = 3
    docs = spark.createDataFrame(rows, docs.schema)
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("sample-1")).alias("h")).collect()}
    learn = {}
    for r in sorted(rows, key=lambda r: order[r["doc_id"]]):
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            learn.setdefault(r["lang"], []).append(r["text"])
    profiles = LID.learn_profiles(docs, few)
    assert profiles == {lang: plain_profile(texts[:few]) for lang, texts in sorted(learn.items())}
    got = {r["doc_id"]: r for r in LID.predict_languages(docs, profiles=profiles).collect()}
    for r in rows:
        own = plain_profile([r["text"] or ""])
        if not own:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p.index(g) - i) if g in p else LID.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(1 - far[best] / (LID.PROFILE * len(own)))


def test_repeated_ids_do_not_fill_the_sample(spark):
    rows = [(7, f"word{i} again", "en") for i in range(300)] + [(i, "some other words here", "en") for i in range(10, 40)]
    profiles = LID.learn_profiles(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 5)
    assert list(profiles) == ["en"] and len(profiles["en"]) < 120


def test_language_id(spark, hard, clashing, empty):
    en, de = "the people walk along with their children and they think that this is good", "die leute gehen und denken nicht dass der weg sich für das kind lohnt"
    rows = [(i, (en if i % 2 else de) + f" {'and' if i % 2 else 'und'} " * (i % 5), "en" if i % 2 else "de") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in LID.predict_languages(docs).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    for docs in (hard, clashing):
        told = LID.predict_languages(docs).collect()
        assert sorted((str(r["doc_id"]), r["lang_pred"] == "und") for r in told) == sorted(
            (str(r["doc_id"]), not any(c.isalpha() for c in r["text"] or "")) for r in hard.collect()
        )
        out = LID.drop_unidentified(docs)
        assert out.columns == docs.columns and out.count() == 12
    assert LID.predict_languages(empty).count() == 0 and LID.drop_unidentified(empty).count() == 0


def test_unlearned_languages_keep_documents_with_letters(spark, hard):
    docs = hard.withColumn("lang", F.lit(None).cast("string"))
    assert LID.learn_profiles(docs) == {}
    out = LID.drop_unidentified(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(r["text"] for r in hard.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_rank_distance():
    places = LID.top_places(np.bincount([5, 5, 5, 9, 9, 2, 7], minlength=1 << 16), 3)
    assert places.tolist() == [5, 9, 2]
    p = LID.Profiles({"a": [5, 9], "b": [9, 5]})
    top = LID.top_places(np.bincount([5, 5, 9], minlength=1 << 16))
    ranks = p.ranks[:, top]
    assert np.abs(ranks - np.arange(2)).sum(1).tolist() == [0, 2]


def labelled(spark, bad: str, good: str, n: int = 300, column: str = "quality"):
    rnd = random.Random(1)
    words = good.split()
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(30)) + ". " + " ".join(rnd.choice(words) for _ in range(20)) + "."
        flag = i % 3 == 0
        rows.append((i, text + (f" {bad} {rnd.choice(words)}." if flag else "")))
        labels.append((i, int(flag)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, f"doc_id bigint, {column} int")


def test_quality_learns_and_holds_out(spark, hard, clashing, empty):
    docs, labels = labelled(spark, "!!! $$$ !!! $$$", "river stone bread market letters morning people walls")
    labels = labels.withColumn("quality", 1 - F.col("quality"))
    weights = QL.fit_quality(docs, labels)
    told = QL.score_quality(docs, weights).join(labels, "doc_id").withColumn("held", fold("doc_id", 5) == 0).collect()
    held = [r for r in told if r["held"]]
    assert len(held) > 20 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(QL.fit_quality(docs, flipped), weights)  # held-out labels are never seen
    for frame in (hard, clashing):
        scores = [r["score"] for r in QL.score_quality(frame, weights).collect()]
        assert len(scores) == 16 and all(0 <= s <= 1 for s in scores)
    assert QL.score_quality(empty, weights).count() == 0
    none = QL.fit_quality(docs, labels.limit(0))
    assert not none.any() and QL.score([""], none)[0] == 0.5
    assert QL.fit_quality(empty, labels).shape == weights.shape


def test_quality_features_against_plain():
    slots, values, counts = QL.features(["a b a", "", "A!! a"])
    assert counts.tolist()[1] == 0 and counts[0] == 2 + 2 + 1  # a, b, two bigrams, a again after one
    assert np.allclose([np.linalg.norm(v) for v in np.split(values, np.cumsum(counts)[:-1]) if len(v)], 1)


def test_toxicity_finds_documents_and_sentences(spark, hard, clashing, empty):
    docs, labels = labelled(spark, "you nasty", "river stone bread market letters morning people walls", 400, "toxic")
    weights = TX.fit_toxicity(docs, labels)
    told = TX.score_toxicity(docs, weights).join(labels, "doc_id").withColumn("held", fold("doc_id", 5) == 0).collect()
    held = [r for r in told if r["held"]]
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.95
    found = TX.offending_sentences(docs, weights).collect()
    assert found and np.mean(["nasty" in r["words"] for r in found]) > 0.95
    for frame in (hard, clashing):
        scores = [r["score"] for r in TX.score_toxicity(frame, weights).collect()]
        assert len(scores) == 16 and all(0 <= s <= 1 for s in scores)
    assert TX.score_toxicity(empty, weights).count() == 0 and TX.offending_sentences(empty, weights).count() == 0
    assert TX.SentenceScorer(weights).score("") == 0.0
    none = TX.fit_toxicity(docs, labels.limit(0))
    assert TX.SentenceScorer(none).score("some words") < 0.01


def test_offending_places(spark):
    """Places against the text itself, also in sentences cut by the window, and the words of each."""
    text = "One two.  Three -- 4 four!\n\n" + "w1 " * 45 + "\nÄh, so? " + "😀 last"
    spans, words = TX.sentence_spans(text), TX.sentences(text)
    assert len(spans) == len(words) == 6
    for (a, b), own in zip(spans, words, strict=True):
        assert list(dict.fromkeys(TX._WORD.findall(text[a:b]))) == own
    assert text[slice(*spans[1])] == "Three -- 4 four" and text[slice(*spans[-1])] == "last"
    weights = np.zeros((1 << TX.BITS) + 1)
    weights[-1] = -7.0
    for slot in TX._slots("four"):
        weights[slot] = 12.0
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id bigint, text string")
    (hit,) = TX.offending_sentences(docs, weights).collect()
    assert (hit["doc_id"], hit["sentence"], hit["words"]) == (1, 1, "Three -- 4 four") and text[hit["start"] : hit["stop"]] == hit["words"]
    told = {r["doc_id"]: r["offending"] for r in TX.score_toxicity(docs, weights).collect()}
    assert told[2] == told[3] == [] and told[1][0]["start"] == hit["start"]


def plain_noisy_or(rows, passes, batch):
    """Adaptive steps on the noisy-or likelihood, document by document, slot by slot; rows of (sentences, label)."""
    bias, none = 1 << TX.BITS, (1 << TX.BITS) - 1
    w, power = {bias: TX.PRIOR}, {}
    for _ in range(passes):
        for first in range(0, len(rows), batch):
            part = rows[first : first + batch]
            g = {}
            for own, label in part:
                slots = [[x for word in s for x in TX._slots(word)] for s in own]
                p = [1 / (1 + math.exp(-(w[bias] + sum(w.get(x, 0.0) for x in s)))) for s in slots]
                clean = math.prod(1 - q for q in p)
                for s, q in zip(slots, p, strict=True):
                    pull = -q * clean / (1 - clean) if label else q
                    for x in [*s, bias]:
                        g[x] = g.get(x, 0.0) + pull
            g.pop(none, None)
            for x, value in w.items():
                if x != bias:
                    g[x] = g.get(x, 0.0) + TX.DECAY * len(part) * value
            for x, value in g.items():
                power[x] = power.get(x, TX.START) + value * value
                w[x] = w.get(x, 0.0) - TX.RATE * value / math.sqrt(power[x])
    return w


def test_toxicity_training_and_scores_against_plain():
    texts = ["good day. nasty you! calm", "calm good day", "some nasty words. here", "words here. and there.", "one", "nasty"] * 3
    rows = [(TX.sentences(t), int("nasty" in t)) for t in texts]
    flat = [s for own, _ in rows for s in own]
    slots = np.array([TX._slots(w) for s in flat for w in s])
    got = TX.train(
        slots,
        np.repeat(np.arange(len(flat)), [len(s) for s in flat]),
        np.repeat(np.arange(len(rows)), [len(own) for own, _ in rows]),
        np.array([label for _, label in rows]),
        passes=4,
        batch=5,
    )
    want = plain_noisy_or(rows, 4, 5)
    dense = np.zeros_like(got)
    dense[list(want)] = list(want.values())
    assert np.allclose(got, dense, atol=1e-9)
    scorer = TX.SentenceScorer(got)
    for own, t in zip((own for own, _ in rows), texts, strict=True):
        logits = [want[1 << TX.BITS] + sum(want.get(x, 0.0) for w in s for x in TX._slots(w)) for s in own]
        assert scorer.score(t) == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in logits))
    assert scorer.scores(texts)[0] == pytest.approx([scorer.score(t) for t in texts])


def plain_features(text):
    """slot -> value, token by token."""
    tokens = [xxhash.xxh64_intdigest(t) for t in QL.TOKEN.findall(text)]
    counts = Counter(tokens)
    for a, b in zip(tokens, tokens[1:], strict=False):
        counts[int(QL._SAME) if a == b else (a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F % 2**64] += 1
    counts[int(QL._AGAIN)] += sum(a == b for a, b in zip(tokens, tokens[2:], strict=False))
    slots = Counter()
    for h, n in counts.items():
        slots[h >> (64 - QL.BITS)] += n
    values = {s: 1 + math.log(n) for s, n in slots.items() if n}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {s: v / norm for s, v in values.items()}


def plain_ftrl(rows, passes):
    bias = 1 << QL.BITS
    z, n = Counter(), Counter()

    def weight(s):
        if abs(z[s]) <= QL.L1:
            return 0.0
        return -(z[s] - math.copysign(QL.L1, z[s])) / ((QL.BETA + math.sqrt(n[s])) / QL.ALPHA + QL.L2)

    for _ in range(passes):
        for x, label in rows:
            x = {**x, bias: 1.0}
            w = {s: weight(s) for s in x}
            error = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items()))) - label
            for s, v in x.items():
                g = error * v
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / QL.ALPHA * w[s]
                n[s] += g * g
    return {s: weight(s) for s in z}


def test_quality_training_and_scores_against_plain():
    texts = ["a clean text, nothing else.", "!!! buy buy buy !!!", "a b a b", "", "one_two  Three\nthree", "Ärger 3.5 😀 -- x x"] * 4
    labels = [int("!" not in t) for t in texts]
    rows, weights = [], None
    for t, label in zip(texts, labels, strict=True):
        slots, values, counts = QL.features([t])
        want = plain_features(t)
        assert dict(zip(slots.tolist(), values.tolist(), strict=True)) == pytest.approx(want, rel=1e-6) and counts.tolist() == [len(want)]
        rows.append((slots, values, label))
    weights = QL.train(rows, steps=4 * len(rows))
    plain = plain_ftrl([(dict(zip(s.tolist(), v.tolist(), strict=True)), y) for s, v, y in rows], 4)
    dense = np.zeros_like(weights)
    dense[list(plain)] = list(plain.values())
    assert np.allclose(weights, dense, atol=1e-5)
    want = [1 / (1 + math.exp(-(plain[1 << QL.BITS] + sum(plain.get(s, 0.0) * v for s, v in plain_features(t).items())))) for t in texts]
    assert QL.score(texts, weights) == pytest.approx(want, abs=1e-4)


def test_repeated_ids_give_one_row_to_learn_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(i, "other text") for i in range(2, 30)], "doc_id bigint, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (99, 0)], "doc_id bigint, label int")
    assert sorted(map(tuple, texts_of(docs, chosen).collect())) == [(1, 1, "text 0"), (2, 0, "other text"), (3, 1, "other text")]


def test_noisy_or():
    logits, doc = np.array([0.0, 1.0, -2.0]), np.array([0, 0, 1])
    p = 1 / (1 + np.exp(-logits))
    clean = np.exp(TX._noisy_or(logits, doc, 3))
    assert np.allclose(clean, [(1 - p[0]) * (1 - p[1]), 1 - p[2], 1.0])
    assert TX.sentences("One two. Three!\n\nfour " + "w " * 85)[:2] == [["One", "two"], ["Three"]]
