import random

from chainframes.llm.simhash import keep_one


def runs(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    x, y = runs(a), runs(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def kept_ids(rows):
    """The least id of each part that pairs of similar texts connect."""
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if j < i and label[i] != label[j] and alike(a, b):
                label = {k: min(label[i], label[j]) if x in (label[i], label[j]) else x for k, x in label.items()}
    return sorted(set(label.values()))


def test_texts_of_the_same_words_stay(make_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.sample(words, 80))) for i in range(6)]  # one set of words, six orders
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(900))) for i in range(4)]
    rows += [(20, rows[0][1].upper()), (21, rows[1][1] + " more")]  # copies
    got = sorted(r.doc_id for r in keep_one(make_docs(rows)).collect())
    assert got == kept_ids(rows) == [0, 1, 2, 3, 4, 5, 10, 11, 12, 13]


def test_a_large_group_of_near_copies(make_docs):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        mine = list(words)
        mine[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(mine)))
    assert [r.doc_id for r in keep_one(make_docs(rows)).collect()] == [0]


def test_edited_copies_go(make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(20000)}" for _ in range(60 + 3 * i)]
        rows.append((i, " ".join(words)))
        for k in range(len(words) // 50):
            words[25 + 50 * k] = f"x{i}x{k}"
        rows.append((100 + i, " ".join(words)))
    want = kept_ids(rows)
    assert want == list(range(60))
    got = sorted(r.doc_id for r in keep_one(make_docs(rows)).collect())
    assert not set(want) - set(got) and len(got) <= len(want) + 2


def test_one_id_with_two_texts(make_docs):
    rng = random.Random(7)
    a, b, c = (" ".join(f"w{rng.randrange(9000)}" for _ in range(90)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (3, c), (7, c), (7, a + " more")]
    assert sorted((r.doc_id, r.text) for r in keep_one(make_docs(rows)).collect()) == sorted([(5, a), (5, b), (3, c)])
    rows = [(3, c), (7, c), (7, b)]  # one text of 7 is a copy, the other is not
    assert sorted((r.doc_id, r.text) for r in keep_one(make_docs(rows)).collect()) == sorted([(3, c), (7, b)])
