"""Verification of test items and unknown runs: plain versions beside them, and texts that a quadratic version would never finish."""

import random
import time

from lemmaflow.llm import decontaminate, token_counts
from lemmaflow.llm.queries import tokenizer_path
from tests.llm.test_llm import WORDS, frame, text

LIMITS = (decontaminate.STRIDE, decontaminate.THRESHOLD, decontaminate.MIN_QUESTION, decontaminate.MIN_ANSWER, decontaminate.GRAM)


def common(a, b, low, width, first=0):
    """Longest common subsequence of pairs whose shift lies in the band; ``first`` is a's place in the item."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            hit = x == y and low <= j - (i + first) <= low + width
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + hit)
    return table[-1][-1]


def plain_in_order(item, n_question, region):
    n, n_answer = len(item), len(item) - n_question
    lack, step = n // 4, max(1, n // 8)
    width = lack + step - 1
    need_q, need_a = min(n_question - 1, -(-3 * n_question // 5)), max(0, min(n_answer - 1, -(-n_answer // 2)))
    for low in range(-(width // step) * step, len(region) + 1, step):
        q, a = common(item[:n_question], region, low, width), common(item[n_question:], region, low, width, n_question)
        if common(item, region, low, width) >= n - lack and q >= need_q and a >= need_a:
            return q / n_question, a / n_answer if n_answer else 1.0
    return None


def test_in_order_equals_the_plain_table():
    rng, found = random.Random(1), 0
    for k in range(250):
        few = WORDS[: rng.choice([2, 4, 40])]
        item = [rng.choice(few) for _ in range(rng.randint(1, 24))]
        n_question = rng.randint(1, len(item))
        region = [rng.choice(few) for _ in range(rng.randint(0, 12))] + [w for w in item if rng.random() < 0.85] + [rng.choice(few) for _ in range(rng.randint(0, 12))]
        got = decontaminate.in_order(item, n_question, region, 0.6, 0.5)
        assert got == plain_in_order(item, n_question, region), (k, item, n_question, region)
        found += got is not None
    assert 50 < found < 240


def test_leaks_equal_plain_retrieval_and_verification(spark):
    """Every passage scored against every item by plain sums, then overlaps by plain loops."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.randint(6, 14)) + ". " + some(rng.randint(1, 5)) + ".") for i in range(15)]
    docs = []
    for i in range(30):
        ws = decontaminate.words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        docs.append((i, some(rng.randint(0, 50)) + " " + " ".join(ws[: rng.randint(1, len(ws))] if i % 4 == 0 else ws) + " " + some(rng.randint(0, 30))))
    x = decontaminate.build_index(items)
    stride, threshold, min_q, min_a, gram = LIMITS
    want = set()
    for i, t in docs:
        ws = decontaminate.words(t)
        for k, item in enumerate(x.items):
            weights = {term: x.weights[n][x.docs[n].index(k)] for term, n in x.terms.items() if k in x.docs[n]}
            places = [p for p in range(-(-len(ws) // stride)) if sum(weights.get(w, 0) for w in set(ws[p * stride : (p + 2) * stride])) >= threshold]
            if not places:
                continue
            item_words, n_question = x.texts[k]
            share = lambda need: 1.0 if not need else len(need & decontaminate.grams(ws, len(next(iter(need))))) / len(need)
            enough = share(x.questions[k]) >= min_q and share(x.answers[k]) >= min_a
            n = len(item_words)
            if enough or any(plain_in_order(item_words, n_question, ws[max(0, p * stride - n) : (p + 2) * stride + n]) for p in places):
                want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()}
    assert want <= got and len(got - want) <= len(want) // 10 and len(want) > 8  # regions that overlap are searched as one, so a band may cross their ends


def test_repetitive_texts_are_verified_in_time():
    rng = random.Random(2)
    few = ["alpha", "beta", "gamma", "delta"]
    items = [(i, " ".join(rng.choice(few) for _ in range(n)) + ". " + " ".join(rng.choice(few) for _ in range(9)) + ".") for i, n in enumerate((40, 200, 400))]
    x = decontaminate.build_index(items)
    for t in (" ".join(rng.choice(few) for _ in range(18_000)), "alpha " * 17_000, "alpha beta gamma delta " * 4_400, "\n".join(f"alpha | {k % 7} | beta" for k in range(6_000))):
        assert len(t) > 90_000
        began = time.process_time()
        decontaminate.search(x, t, *LIMITS)
        assert time.process_time() - began < 6  # three items, under 2 s each
    assert {r[0] for r in decontaminate.search(x, "alpha " * 9000 + items[2][1] + " beta" * 9000, *LIMITS)} >= {2}


def test_unknown_runs_are_counted_in_time():
    counter = token_counts.Counter(token_counts.read_vocabulary(tokenizer_path("piece_bpe_32k.model")), 0, True)
    plain = token_counts.Counter(token_counts.read_vocabulary(tokenizer_path("piece_bpe_32k.model")), 0, False)
    for unit in ("\U00013000", "日\U00013001", "é͸", "x" * 3 + "͹"):
        t = unit * (100_000 // len(unit))
        began = time.process_time()
        counter.text(t)
        assert time.process_time() - began < 2
    assert counter.text("\U00013000" * 1000) == 1 + 4 * 1000 and plain.text("\U00013000" * 1000) == 2
