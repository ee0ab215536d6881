"""Operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fileledger.llm import hamming, language, minhash, mixing, neighbours, packing, quality, sharding, toxicity, url_filter
from fileledger.llm.common import components, prefix_sums, tokenizer_file

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, _key string"


def text(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "k") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(i, 5 + i % 40), ("en", "xx", None)[i % 3], ("a", "b", None)[i % 3]) for i in range(60)]
    long = text(99, 6000)
    return [*out, (60, None, None, None), (61, "", "en", "a"), (62, " \n", "en", "b"), (63, long, "en", "a"), (None, "no id", "en", "c"),
            (5, text(5, 10), "en", "a"), (5, text(5, 10), "en", "a"), (70, text(7, 12), "en", "a"), (71, "Ünï cödé 漢字", "xx", "é")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_prefix_sums(spark):
    df = spark.createDataFrame([(g, i, i % 4) for g in (None, "a", "b") for i in range(30)], "g string, i int, w int")
    got = {(r.g, r.i): r.before for r in prefix_sums(df, ["g"], ["i"], F.col("w")).collect()}
    assert got == {(g, i): sum(k % 4 for k in range(i)) for g in (None, "a", "b") for i in range(30)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?q", "http://example.net/en/", "http://x.net", "https://net/", "http://u.example.com/de/9#z", "ftp://z.org/fr/", "no", None, "", "://",
            "http://a.org/x?://b.net/y", "http://casino-slots.example.org/en/1", "http://gardening.example.org/en/1", "http://EXAMPLE.NETX/en/", "http://notexample.net/en/1", "http://h/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]

    for i, u in enumerate(urls):
        host, path = parts(u)
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fit)[1] if fit else None), u
        if fit:
            assert got[i].verdict == max(fit)[2]
    assert got[11].verdict == "block" and got[12].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_weights_match_gradient_descent(spark):
    labelled = spark.createDataFrame([("http://casino.example.com/a", 1), ("http://garden.example.com/b", 0), ("http://casinos.example.org/a", 1)], "url string, blocked int")
    weights = url_filter.fit_weights(labelled, rounds=50)
    host, path = url_filter.host_and_path(F.col("url"))
    data = labelled.select("blocked", url_filter.grams(host, "h").alias("h"), url_filter.grams(path, "p").alias("p")).collect()
    x = np.zeros((3, url_filter.BUCKETS + 1))
    for i, r in enumerate(data):
        for b in r.h:
            x[i, b] += 1 / np.sqrt(len(r.h))
        for b in r.p:
            x[i, b] += url_filter.PATH_SHARE / np.sqrt(len(r.p))
        x[i, -1] = 1
    w, y = np.zeros(x.shape[1]), np.array([r.blocked for r in data])
    for _ in range(50):
        w = w * (1 - 4.0 * 1e-3) + 4.0 / 3 * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    assert np.allclose(weights, w)


def test_mixing(spark, rows, docs, empty):
    plan = [tuple(r)[:6] for r in mixing.mix_plan(docs).collect()]
    assert len(plan) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        left, free = left - sum(2 * sizes[s] for s in over), free - set(over) if over else set()
    taken = defaultdict(int)
    for _, s, size, source_size, aimed, got in plan:
        taken[s] += got
        assert source_size == sizes[s] and aimed == pytest.approx(target[s]) and 0 <= got <= 2 * size
    assert all(taken[s] == int(target[s] + 0.5) for s in names)
    assert sorted(plan, key=str) == sorted((tuple(r)[:6] for r in mixing.mix_plan(docs).collect()), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.encode().split())
    # Rows that are equal in id and text may share the cut.
    assert all(abs(words[s] - taken[s]) <= 20 for s in names)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_sharding(spark, rows, docs, empty):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_text = {i: t or "" for i, t, _, _ in rows}
    place = defaultdict(set)
    for r in got:
        t = by_text[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        place[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(30):
        sizes, capacity = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True), rng.randint(50, 120)
        free = []
        for s in sizes:
            fit = [f for f in free if f >= s]
            if fit:
                free[free.index(min(fit))] -= s
            else:
                free.append(capacity - s)
        bins = sharding.best_fit_decreasing(sizes, capacity)
        assert max(bins) + 1 == len(free)
        load = Counter()
        for s, b in zip(sizes, bins, strict=True):
            load[b] += s
        assert sorted(capacity - x for x in load.values()) == sorted(free)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_packed_like_single_groups(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 30) ** 2 for _ in range(400)), reverse=True)
    runs = sorted(Counter(sizes).items(), reverse=True)
    for capacity in (900, 1500, 9000):
        bins = sharding.best_fit_decreasing(sizes, capacity)
        moves = sharding.best_fit_runs(runs, capacity, len(sizes))
        one, other = Counter(), Counter()
        for s, b in zip(sizes, bins, strict=True):
            one[b] += s
        for s, _, n, b in moves:
            other[b] += s * n
        assert sorted(one.values()) == sorted(other.values())
        for s, n in runs:  # ranks of a size are dealt once each
            assert sorted(r for size, first, m, _ in moves if size == s for r in range(first, first + m)) == list(range(n))
    assert sharding.best_fit_runs(runs, sizes[0] - 1, 10**6) is None and sharding.best_fit_runs(runs, 900, 1) is None


def test_many_small_groups_are_packed_by_size(spark):
    """50,000 groups, each far below 1/16384 of all bytes, against best fit one by one."""
    rng = random.Random(8)
    rows = [(i, f"{i} " + "x" * rng.randint(1, 90), "en", "a") for i in range(50_000)]
    got = sharding.shard_documents(table(spark, rows), shards=8).collect()
    sizes = sorted((len(t) + 1 for _, t, _, _ in rows), reverse=True)
    even = -(-sum(sizes) // 8)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    plain = Counter()
    bins = sharding.best_fit_decreasing(sizes, max(load.values()), 8)
    for s, b in zip(sizes, bins, strict=True):
        plain[b] += s
    # The least capacity is searched to one part in 100,000.
    assert sorted(load.values()) == sorted(plain.values()) and max(load.values()) <= even + even // 100_000 + 1
    most = Counter(r.shard for r in got if r["size"] == sizes[0])
    assert len(most) == 1  # the largest fill one shard before the next is opened


def test_packing(spark, rows, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = packing.pack_documents(docs, length=64).collect()
    pieces = Counter()
    for i, t, _, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, k in enumerate(range(0, len(ids), 64)):
            part = ids[k : k + 64]
            pieces[i, n, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == pieces
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r["length"]))
    for parts in filled.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    assert len(filled) <= 1.1 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("word", ["it's", "<|endoftext|>x", "ÀÉÎ", "don't!!", "áb", "½x²", "漢字kanji", "x y", "A.B,c", "ﬁn"])
def test_word_ids_are_the_tokenizers(word):
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = packing.WordIds(f.read())
    whole = f"{word} and\t{word}\n{word}"
    assert ids.direct
    assert ids.ids(whole) == np.array(ids.tokenizer.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()


def test_language(spark, empty):
    english = ["the house and the garden", "with that there would be", "from the other side of it"]
    german = ["das haus und der garten", "mit dem würde es sein", "von der anderen seite"]
    rows = [(i, (english, german)[i % 2][i // 2 % 3] + " " + (english, german)[i % 2][i % 3], ("en", "de")[i % 2], "s") for i in range(120)]
    rows += [(500, None, "en", "s"), (501, "12 34 !?", "en", "s"), (502, "", None, "s"), (None, english[0], None, "s"), (503, "the garden " * 5000, None, "s"), (504, "x" * 3000, None, "s")]
    got = {r.doc_id: r for r in language.predict_language(table(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:120])
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[None].lang_pred == got[503].lang_pred == "en"
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict_language(empty).count() == 0


def test_segmentation_sums():
    names = ["a", "ab", "b", "▁", "▁a"]
    model = language.Pieces(names, np.array([[0.2, 0.3, 0.1, 0.25, 0.15]]))
    # ▁ a b: [▁][a][b], [▁][ab], [▁a][b]
    assert np.exp(model.log_probabilities(["ab"]))[0, 0] == pytest.approx(0.25 * 0.2 * 0.1 + 0.25 * 0.3 + 0.15 * 0.1)
    total = 0.25 * 0.2 * 0.1 + 0.25 * 0.3 + 0.15 * 0.1
    assert model.expected(["ab"], np.array([2.0]), 0)[1] == pytest.approx(2 * 0.25 * 0.3 / total)


@pytest.mark.parametrize("length", [3, 12, 60, 400])
def test_long_words_and_pieces_are_summed_whole(length):
    """Against a plain recursion: a piece of twelve letters, words far beyond the range of a product."""
    rng = random.Random(length)
    names = ["a", "b", "ab", "▁", "▁a", "abbaabbaabba", "ba" * 7]
    p = [0.2, 0.1, 0.15, 0.2, 0.05, 0.2, 0.1]
    model = language.Pieces(names, np.array([p, p[::-1]]))
    word = "".join(rng.choice(["a", "b", "abbaabbaabba", "c"]) for _ in range(length))[:length]
    marked = "▁" + word
    for lang, chances in enumerate((p, p[::-1])):
        chance = dict(zip(names, chances, strict=True))
        weight = lambda x: chance.get(x, language.UNKNOWN if len(x) == 1 else 0)
        fore, back = [Fraction(1)], {len(marked): Fraction(1)}
        for end in range(1, len(marked) + 1):
            fore.append(sum(fore[end - k] * Fraction(weight(marked[end - k : end])) for k in range(1, min(14, end) + 1)))
        for start in range(len(marked) - 1, -1, -1):
            back[start] = sum(back[start + k] * Fraction(weight(marked[start : start + k])) for k in range(1, min(14, len(marked) - start) + 1))
        exact = fore[-1]
        log = math.log(exact.numerator) - math.log(exact.denominator)
        assert model.log_probabilities([word, "a"])[0, lang] == pytest.approx(log)
        uses = model.expected([word], np.array([3.0]), lang)
        for name, use in zip(names, uses, strict=True):
            want = sum(fore[i] * Fraction(chance[name]) * back[i + len(name)] for i in range(len(marked)) if marked.startswith(name, i))
            assert use == pytest.approx(float(3 * want / exact))


def test_learned_piece_probabilities_are_those_of_plain_em(spark):
    """One text a language, two rounds of expectation maximisation by hand."""
    train = spark.createDataFrame([(1, "ab ab ba", "x"), (2, "bb a", "y"), (3, "ab", "x"), (4, "ab", "x")], "doc_id long, text string, lang string")
    languages, names, table = language.fit_pieces(train, rows=100, rounds=2)
    assert languages == ["x", "y"] and len(names) > 20_000 and {"▁the"} <= set(names) and max(map(len, names)) > 8
    counts = {"x": Counter({"ab": 4, "ba": 1}), "y": Counter({"bb": 1, "a": 1})}
    at = {n: i for i, n in enumerate(names)}
    want = np.full((2, len(names)), 1 / len(names))
    for _ in range(2):
        new = np.zeros_like(want)
        for i, lang in enumerate(languages):
            for word, n in counts[lang].items():
                marked, ways = "▁" + word, []
                for cuts in range(2 ** (len(marked) - 1)):
                    ends = [k for k in range(1, len(marked)) if cuts >> (k - 1) & 1] + [len(marked)]
                    parts = [marked[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    if all(x in at or len(x) == 1 for x in parts):
                        ways.append((math.prod(want[i, at[x]] if x in at else language.UNKNOWN for x in parts), parts))
                total = sum(w for w, _ in ways)
                for w, parts in ways:
                    for x in parts:
                        if x in at:
                            new[i, at[x]] += n * w / total
        pooled, mass = new.sum(0) + 0.01, np.maximum(new.sum(1, keepdims=True), 1.0)
        want = np.maximum((new + 0.01 * mass * pooled / pooled.sum()) / (1.01 * mass), language.LEAST_PROBABILITY)
    assert np.allclose(table, want, rtol=1e-9)


def test_quality(spark, empty):
    good = [(i, text(i, 80) + ".\n" + text(i + 1, 60) + ".", "en", "s") for i in range(200)]
    bad = [(i, "### " * 40 + "$$$ %%% " * (i % 9), "en", "s") for i in range(200, 300)]
    docs = table(spark, [*good, *bad, (300, None, "en", "s"), (301, "", "en", "s"), (None, "x", "en", "s")])
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(5, 1, 0), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 303 and all(got[i].predicted == int(i < 200) for i in range(300))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def test_isotonic():
    assert list(quality.isotonic(np.array([1.0, 3.0, 2.0, 0.0, 5.0]), np.ones(5))) == [1.0, 5 / 3, 5 / 3, 5 / 3, 5.0]


def test_toxicity(spark, empty):
    clean = [(i, text(i, 60), "en", "s") for i in range(300)]
    toxic = [(i, f"{text(i, 25)} you rotten scoundrel villain {text(i + 1, 25)}", "en", "s") for i in range(300, 360)]
    docs = table(spark, [*clean, *toxic, (400, None, "en", "s"), (401, "", "en", "s"), (402, text(1, 9000) + " rotten villain scoundrel", "en", "s")])
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(360)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_passages(docs, labels).collect()}
    assert all(got[i].predicted == int(i >= 300) for i in range(360)) and got[402].predicted == 1
    assert got[400].predicted == got[401].predicted == 0
    span = got[310].passages[0]
    assert {"rotten", "scoundrel", "villain"} <= set(toxicity.tokens_of(dict((i, t) for i, t, _, _ in toxic)[310])[span.first : span.behind])
    assert {r.score for r in toxicity.score_passages(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_passages(empty, labels).count() == 0


def test_maximal_segments_are_the_recursive_ones():
    rng = random.Random(4)

    def recursive(x, a, b):
        best = max(((sum(x[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        # Of equal sums the shortest: its ends cannot be shortened.
        s, i, j = min(((j - i, i, j) for i in range(a, b) for j in range(i + 1, b + 1) if abs(sum(x[i:j]) - best[0]) < 1e-12))
        return recursive(x, a, i) + [(i, j)] + recursive(x, j, b)

    for _ in range(200):
        x = [rng.choice([-0.1, -0.1, -0.1, rng.uniform(0.05, 1)]) for _ in range(14)]
        items = [(i, v) for i, v in enumerate(x) if v != -0.1]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(items, -0.1)] == recursive(x, 0, len(x))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, empty, width, percent):
    rng = random.Random(5)
    near = []
    for i in range(100, 160):
        words = text(1000 + i % 6, 120).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = "changed"
        near.append((i, " ".join(words), "en", "s"))
    data = [*rows, *near]
    got = minhash.near_duplicates(table(spark, data), width, percent).collect()
    sets = []
    for _, t, _, _ in data:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(data)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(data):
        if i is not None:
            least[find(k)].append(i)
    expected = Counter((i, len(sets[k]), min(least[find(k)], default=None)) for k, (i, *_) in enumerate(data))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty, width, percent).count() == 0


def base_words(changed=0):
    return [*[f"w{k}" for k in range(200 - changed)], *[f"x{m}" for m in range(changed)]]


def chain(spark, ids):
    """Texts whose neighbours in the list are alike, the others not."""
    texts = [" ".join(base_words(9 * k)) for k in range(len(ids))]
    return table(spark, [(i, t, "en", "a") for i, t in zip(ids, texts, strict=True)])


@pytest.mark.parametrize("ids", [(1, None, 3), (1, 2, 3), (1, 7, 7), (7, 7, 3), (5, None, None, None, 9)])
def test_rows_without_or_with_repeated_ids_bridge(spark, ids):
    got = minhash.near_duplicates(chain(spark, ids), 3, 85).collect()
    low = min(i for i in ids if i is not None)
    assert [r.component_id for r in got] == [low] * len(ids)
    first, third = ({tuple(w[k : k + 3]) for k in range(198)} for w in ([*base_words()], [*base_words(18)]))
    assert 100 * len(first & third) < 85 * len(first | third)


def test_clashing_first_halves_stay_apart(spark, monkeypatch):
    whole = minhash.set_id
    monkeypatch.setattr(minhash, "set_id", lambda h: (whole(h)[0] % 3, whole(h)[1]))
    data = [(i, text(i, 60), "en", "a") for i in range(40)]
    got = minhash.near_duplicates(table(spark, [*data, (50, data[4][1], "en", "a")]), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [*((i, i) for i in range(40)), (50, 4)]


def test_outsiders_of_a_large_bucket_meet_all(spark, monkeypatch):
    """Near copies in one large bucket: blocks small enough that the main group fills several."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, base, out = random.Random(4), [f"w{k}" for k in range(300)], []
    for i in range(90):
        words = list(base)
        for _ in range(i % 16):
            words[rng.randrange(300)] = f"c{rng.randrange(9999)}"
        out.append((i, " ".join(words), "en", "a"))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(298)} for _, t, _, _ in out]
    root = list(range(90))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(table(spark, out), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, find(i)) for i in range(90)]


def test_estimate_is_near_the_similarity():
    order, rng = minhash.fill_order(), np.random.default_rng(1)
    for n in (40, 400, 4000):
        diff = []
        for _ in range(40):
            x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[: int(n * 0.95)]), np.unique(x[int(n * 0.05) :])
            equal = np.array([(minhash.registers(a, order) == minhash.registers(b, order)).mean()])
            diff.append(minhash.estimate(equal, np.array([len(a)]), np.array([len(b)]))[0] - 0.9)
        assert abs(np.mean(diff)) < 0.04


@pytest.mark.parametrize(("i", "j"), [(0, 0), (0, 1)])
def test_links_in_a_bucket_join_the_same_groups(i, j):
    rng, order = np.random.default_rng(5), minhash.fill_order()
    base = np.unique(rng.integers(0, 2**64, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[k % 14 :], rng.integers(0, 2**64, k % 9, dtype=np.uint64)])) for k in range(120)]
    regs = np.stack([minhash.registers(h, order) for h in sets])
    keys = minhash.bucket_keys(regs)
    key = Counter(keys.ravel().tolist()).most_common(1)[0][0]
    band = int((keys == key).any(0).argmax())
    rows = [k for k in range(120) if keys[k, band] == key]
    block = {k: i if i == j else k % 2 for k in rows}
    table = pa.table({
        "key": [key] * len(rows), "i": [i] * len(rows), "j": [j] * len(rows), "block": [block[k] for k in rows], "node": rows, "group": rows,
        "registers": [regs[k].tobytes() for k in rows], "hashes": [sets[k].tobytes() for k in rows],
    })
    found = minhash.links_between(table, 0.85, 85)

    def linked(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        return 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)

    def groups(pairs):
        root = {k: k for k in rows}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        return {frozenset(k for k in rows if root[k] == r) for r in root.values()}

    pairs = list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    first = [(a, b) for a in rows for b in rows if a < b and not (keys[a, :band] == keys[b, :band]).any() and (i == j or block[a] != block[b])]
    assert len(rows) > 20 and pairs and all(linked(a, b) for a, b in pairs)
    assert groups(pairs) == groups([(a, b) for a, b in first if linked(a, b)])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    out, i = [], 0
    for label in (0, 1):
        for _ in range(60):
            out.append((i, rng.normal(size=24).tolist(), label)), (i := i + 1)
        centre = rng.normal(size=24)
        for _ in range(40):
            out.append((i, (centre + 0.05 * rng.normal(size=24)).tolist(), label)), (i := i + 1)
    same = rng.normal(size=24).tolist()
    out += [(1000 + k, same, 1) for k in range(5)] + [(1010, same, 0), (1011, same, None), (1012, None, 1), (1013, [0.0] * 24, 1), (1014, [float("nan")] * 24, 1), (1015, [None] * 24, 1), (1016, same[:5], 1), (None, same, 1)]
    return out


def test_near_vectors(spark, vectors):
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in neighbours.near_vectors(df).collect()}
    ok = [k for k, (i, v, lab) in enumerate(vectors) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: np.float32(vectors[k][1]).astype(float) / np.linalg.norm(np.float32(vectors[k][1]).astype(float)) for k in ok}
    links = defaultdict(set)
    for a in ok:
        for b in ok:
            if a != b and vectors[a][2] == vectors[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
    for k, (i, *_) in enumerate(vectors):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        smallest = min((vectors[x][0] for x in seen if vectors[x][0] is not None), default=None)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[k]), smallest, smallest == i), i
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def close_groups(groups, size, seed, dim=24):
    """Tight groups around centres that lie at a cosine of 0.983 of the first one."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    centres = [basis[0], *[0.983 * basis[0] + np.sqrt(1 - 0.983**2) * basis[g] for g in range(1, groups)]]
    return [[float(x) for x in c + rng.normal(size=dim) * 0.001] for c in centres for _ in range(size)]


def test_near_vectors_between_saturated_groups(spark):
    """Every list is full of the own group; the links to the next group are found all the same."""
    vectors = close_groups(3, 20, 1)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    unit = np.array(vectors, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98).sum(1) - 1
    assert linked[:20].tolist() == [59] * 20 and max(linked[20:]) == 39
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect()}
    assert got == {k: (n, 0) for k, n in enumerate(linked)}


def test_audit_sees_missed_components(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lone = rng.normal(size=(400, 24))
    pairs = [v for c in rng.normal(size=(4, 24)) for v in (c, c * 2 + 0.001)]
    hot = [rng.normal(size=24) * 0.001 + 1 for _ in range(80)]
    rows = [("s", k, 1, [float(x) for x in v]) for k, v in enumerate([*lone, *pairs, *hot])]
    nodes = spark.createDataFrame(rows, "space string, node long, copies long, embedding array<double>")
    nothing = spark.createDataFrame([], "node long, links long, group long")
    assert neighbours.audit(nothing, nodes, 0.98) == 0
    assert neighbours.audit(nothing, nodes.filter("node < 400"), 0.98) == 1
    hot_only = nodes.filter("node >= 408").select("node", F.lit(79).cast("long").alias("links"), F.lit(408).cast("long").alias("group"))
    assert neighbours.audit(hot_only, nodes, 0.98) < 0.2
    found = nodes.filter("node between 400 and 407").selectExpr("node", "1L as links", "node - node % 2 as group")
    assert neighbours.audit(hot_only.unionAll(found), nodes, 0.98) == 1
    monkeypatch.setattr(neighbours, "link_vectors", lambda *_: (None, None, 0.5))
    with pytest.raises(RuntimeError, match="0.5000"):
        neighbours.near_vectors(nodes)


def test_nearest_codes(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in hamming.nearest_codes(df, df.filter("vec_id % 10 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    bits = {i: np.array(v) >= 0 for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in bits if i % 10 == 0]:
        every = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q and len(b) == len(bits[q]))
        assert got[q] == every[:7]
    assert hamming.nearest_codes(df.limit(0), df, k=3).count() == 0


def test_nearest_codes_with_repeated_rows_and_clashing_columns(spark, vectors):
    names = ["code", "dim", "q", "bound", "value", "many"]
    wide = spark.createDataFrame([(*v, *range(6)) for v in [*vectors, *vectors[:30], vectors[40]]], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{n} int" for n in names))
    plain = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    asked = wide.filter("vec_id % 10 = 0")
    found, want = (sorted(map(tuple, hamming.nearest_codes(d, q, k=4).collect())) for d, q in ((wide, asked), (plain, plain.filter("vec_id % 10 = 0"))))
    assert found == want


def test_near_vectors_with_repeated_ids(spark):
    """Rows that share an id are rows of their own, linked or not; equal rows link with each other."""
    rng = np.random.default_rng(9)
    one, two, three = rng.normal(size=(3, 16))
    rows = [(1, one), (1, two), (2, one + 0.001), (3, two + 0.001), (3, two + 0.001), (4, three), (4, three)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 7, 1, "g") for i, v in rows], "vec_id long, embedding array<double>, label int, copies int, group string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
