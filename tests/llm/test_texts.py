import itertools
import random

import numpy as np
import pytest

from quillgraph.llm import leaks as K
from quillgraph.llm import packing as P
from quillgraph.llm import sentences as S
from quillgraph.llm import spam as X


def cut(t):
    return [t[a:b] for a, b in S.units(t)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One ends. Two ends! Three?", ["One ends.", "Two ends!", "Three?"]),
        ("He met Dr. Orvel at 6 p.m. The crane left.", ["He met Dr. Orvel at 6 p.m.", "The crane left."]),
        ("It cost 3.5 km (e.g. zinc) in v1.2.3 beyond St. Orvel Street. Next", ["It cost 3.5 km (e.g. zinc) in v1.2.3 beyond St. Orvel Street.", "Next"]),
        ("“The dock fined it!” said Dr. Orvel. It went.", ["“The dock fined it!” said Dr. Orvel.", "It went."]),
        ('He said: "One. Two." Then he left.', ['He said: "One. Two."', "Then he left."]),
        ("„Das Dock? Nein.“ sagte Dr. Orvel. Am 3. Mai kam es.", ["„Das Dock? Nein.“ sagte Dr. Orvel.", "Am 3. Mai kam es."]),
        ("« Le quai a fermé. Oui. » Le four a dit non.", ["« Le quai a fermé. Oui. »", "Le four a dit non."]),
        ("El horno cerró en EE. UU. El molino no.", ["El horno cerró en EE. UU.", "El molino no."]),
        ("A. B. Brat sold it to Brat, C. D. Nino bought it.", ["A. B. Brat sold it to Brat, C. D.", "Nino bought it."]),
        ("Brat Mfg. GmbH sold to Nuk Transp. Ltd. The end.", ["Brat Mfg. GmbH sold to Nuk Transp. Ltd.", "The end."]),
        ("The dock closed.The mill opened.", ["The dock closed.", "The mill opened."]),
        ("It went ... while the mill stood… Then it fell.", ["It went ... while the mill stood…", "Then it fell."]),
        ("# Head\n\nOne line\ngoes on. Two\nThree", ["# Head", "One line\ngoes on.", "Two", "Three"]),
        ("- First item.\n- Second. Third.", ["- First item.", "- Second.", "Third."]),
        ("(It ended.) Next one", ["(It ended.)", "Next one"]),
        ("去年，他说，“关门了！”，但是没有。第二天，开门。", ["去年，他说，“关门了！”，但是没有。", "第二天，开门。"]),
        ("「終わった。」と述べ、帰った。次に、来た！", ["「終わった。」と述べ、帰った。", "次に、来た！"]),
        ("彼は検査した昨年の秋、港は閉鎖した。", ["彼は検査した", "昨年の秋、港は閉鎖した。"]),
        ("ปีที่แล้วโรงงานปิด 3 แห่ง หลังการประท้วงศาลซื้อ Brat Nuk เหมือง", ["ปีที่แล้วโรงงานปิด 3 แห่ง", "หลังการประท้วงศาลซื้อ Brat Nuk เหมือง"]),
        ("उसने कहा, “बंद किया।” और गया। फिर आया।", ["उसने कहा, “बंद किया।” और गया।", "फिर आया।"]),
        ("1) used cranes > www.a.example/p/1\n2) used cranes > www.a.example/p/2", ["1) used cranes > www.a.example/p/1", "2) used cranes > www.a.example/p/2"]),
        ("Dock mill. Mill mill! Dock.", ["Dock mill.", "Mill mill!", "Dock."]),
        ("The old dock closed; https://a.example/v1.2?x=a.b while the mill ran on. The end came.", ["The old dock closed; https://a.example/v1.2?x=a.b while the mill ran on.", "The end came."]),
        ("", []),
        (" \n\t \n", []),
        ("...", ["..."]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("昨天下雨了然而他们继续工作", ["昨天下雨了", "然而他们继续工作"]),
        ("会议结束了第三天他们返回北京市区", ["会议结束了", "第三天他们返回北京市区"]),
        ("工場は閉鎖されました翌朝みんなが帰りました", ["工場は閉鎖されました", "翌朝みんなが帰りました"]),
        ("เขาไปตลาดแล้วเธอกลับบ้าน", ["เขาไปตลาดแล้ว", "เธอกลับบ้าน"]),
        ("他错过了今天的会议", ["他错过了今天的会议"]),
        ("他看见了他们", ["他看见了他们"]),
        ("除了今天他们都来", ["除了今天他们都来"]),
        ("ปีที่แล้วเธอไปตลาด", ["ปีที่แล้วเธอไปตลาด"]),
        ("「すごい！」と言いました。「すごい！」ところが帰った。", ["「すごい！」と言いました。", "「すごい！」", "ところが帰った。"]),
    ],
)
def test_units_without_marks_come_from_the_lattice(text, want):
    for words in ((), S.vocabulary_words()):
        lattice = S.lattice_of(words)
        assert [text[a:b] for a, b in S.units(text, lattice)] == want
    off = S.Lattice()
    off.cost, off.longest = {}, 1
    if len(want) != 1:
        assert [text[a:b] for a, b in S.units(text, off)] != want


def test_long_link_line_is_one_unit():
    line = " | ".join(f"https://a.example/p/{i}" for i in range(400))
    assert len(line) > 5000 and S.units(line + "\n\nThe end.") == [(0, len(line)), (len(line) + 2, len(line) + 10)]


def test_vocabulary_words_of_a_missing_file(tmp_path):
    assert S.vocabulary_words(str(tmp_path / "none")) == ()


def test_units_invariants():
    rng = random.Random(7)
    bits = ["The dock", " closed", ".", " ", "\n", "\n\n", "“", "”", '"', "(", ")", "Dr.", "了。", "第二", "ปี", " 3", "।", "!", "?", "...", "- ", "# ", "https://x.example/a.b", "Ltd.", " ", "\r\n", "»", "«", "a"]
    for _ in range(600):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        got = S.units(t)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        covered = set(itertools.chain.from_iterable(range(a, b) for a, b in got))
        assert all(c.isspace() or i in covered for i, c in enumerate(t))


def test_units_long_text_is_linear():
    t = "The dock closed the mill near Dr. Orvel. " * 20_000
    assert len(S.units(t)) == 20_000
    S.units("(" * 5000 + "a." * 5000)


DOC = "doc_id bigint, document_id string, text string, item_id string, words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, f"h{i}", t, "clash", 1) for i, t in rows], DOC)


def test_sentence_units_frame(spark):
    d = docs(spark, [(1, "One. Two."), (1, "One. Two."), (2, None), (3, "  ")]).unionByName(docs(spark, [(4, "X.")]).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "document_id", "text", "item_id", "words"))
    got = sorted((r.doc_id, r.char_start, r.char_end) for r in S.sentence_units(d).collect())
    assert got == [(1, 0, 4), (1, 5, 9)]
    assert S.sentence_units(docs(spark, [])).count() == 0


SENT = "The buried glacier Trunfal concealed the brackish meadow under Kamdren through the silvered shipwreck 1781 whereas the hollow lagoon mapped the shallow lighthouse"


def leak(spark, texts, sentence=SENT):
    items = spark.createDataFrame([("q1", sentence), ("q2", sentence), ("q3", "too short to be a passage"), ("q4", None)], "item_id string, sentence string")
    return {(r.doc_id, r.item_id) for r in K.leaked(docs(spark, list(enumerate(texts))), "doc_id", "text", items).collect()}


def test_leaks(spark):
    w = SENT.split()
    texts = [
        "Intro words here. " + SENT + ". And more.",
        " ".join(w[3:15]),
        " ".join(w[3:14]),  # 11 words
        "Zero. " + " ".join(w[:5] + ["NEW"] + w[6:12] + ["other"] + w[12:]).upper(),
        " ".join(w[:4] + ["x"] + w[5:8] + ["y"] + w[9:11] + ["z"] + w[12:13]),
        "<b>" + "</b> [12] ".join(w[4:18]) + "&nbsp;",
        None,
        "",
        "nothing of the kind " * 3000,
    ]
    assert {d for d, _ in leak(spark, texts)} == {0, 1, 3, 5}
    assert {i for d, i in leak(spark, texts) if d == 1} == {"q1", "q2"}
    assert leak(spark, []) == set()
    assert K.leaked(docs(spark, [(1, SENT)]), "doc_id", "text", spark.createDataFrame([], "item_id string, sentence string")).count() == 0


def test_leaks_by_blocks_of_the_evaluation_set(spark, monkeypatch):
    other = "A second sentence of the set names twelve words or more so that it may leak too"
    items = spark.createDataFrame([("q1", SENT), ("q2", other), ("q3", SENT)], "item_id string, sentence string")
    d = docs(spark, [(1, SENT), (2, other), (3, "<a " + "href=x " * 100 + ">" + other), (4, SENT + " " + other)])
    find = lambda: {(r.doc_id, r.item_id) for r in K.leaked(d, "doc_id", "text", items).collect()}
    whole = find()
    monkeypatch.setattr(K, "BLOCK_WORDS", 1)
    assert find() == whole == {(1, "q1"), (1, "q3"), (2, "q2"), (3, "q2"), (4, "q1"), (4, "q2"), (4, "q3")}


def test_leak_accents(spark):
    s = "Der überdauernde Gletscher beschrieb das große Gebäude über dem öden Moor während die schöne Müllerin das Tagebuch las"
    spelled = s.replace("ü", "ue").replace("ö", "oe").replace("ä", "ae").replace("ß", "ss")
    plain = s.replace("ü", "u").replace("ö", "o").replace("ä", "a").replace("ß", "ss")
    assert {d for d, _ in leak(spark, [spelled, plain.upper()], s)} == {0, 1}


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(2)
    index = K.Index([([f"w{i}" for i in rng.integers(0, 400, 40)], ["q"]) for _ in range(20)])
    probes = np.concatenate([index.prints[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), rng.integers(0, 2**63, 200).astype(np.uint64)])
    a, b = index.candidates(probes)
    want = {(i, j) for i, p in enumerate(probes) for j in np.flatnonzero(np.bitwise_count(p ^ index.prints) <= K.RADIUS)}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 200


def test_holds_against_brute_force():
    rng = random.Random(3)

    def distance(a, b):
        r = list(range(len(b) + 1))
        for x in a:
            new = [r[0] + 1]
            for k, y in enumerate(b, 1):
                new.append(min(r[k] + 1, new[-1] + 1, r[k - 1] + (x != y)))
            r = new
        return r[-1]

    def anchored(span, region):
        firsts = [p for p, x in enumerate(region) if x == span[0]]
        lasts = [p for p, x in enumerate(region) if x == span[-1]]
        return min([distance(span[1:-1], region[p + 1 : q]) for p in firsts for q in lasts if p < q], default=99)

    for _ in range(25):
        sent = [rng.randrange(30) for _ in range(14)]
        region = sent[rng.randrange(3) :]
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(region))
            region[p : p + 1] = rng.choice([[], [99], [region[p], 98]])
        # First and last word in place: the edits lie between two places of the region.
        want = any(anchored(sent[i:j], region) <= (j - i) // 6 for i in range(3) for j in range(i + 12, 15))
        assert K.holds(np.array(sent), np.array(region)) == want


def test_spam(spark):
    prose = ["The joint dock leased the old mill near the quarry.", "The old mill supplied the joint dock without the quarry.", "The quarry fined the joint mill near the old dock."]
    pages = [
        " ".join(prose), "\n".join(prose[::-1]), prose[1],
        "used cranes used cranes used cranes used cranes bearing discount used cranes used cranes",
        "1) used cranes > www.a.example/p/1\n2) used cranes > www.a.example/p/2",
        "Tags: pumps sale; valve sale; cheap bolts; pumps now",
        prose[0] + "\n" + prose[1] + "\n- https://a.example/1\n- https://a.example/2",
        "叉车租赁 叉车租赁 阀门批发 叉车租赁 叉车租赁",
        "anvil gorse plinth wicker sluice tansy coulter bodkin gimlet",
        None, "", "   \n ",
    ]
    got = {r.doc_id: r for r in X.page_scores(docs(spark, list(enumerate(pages)) + [(3, pages[3])])).collect()}
    assert {d for d, r in got.items() if r.is_spam} == {3, 4, 5, 7, 8}
    assert got[3].n_chars == len(pages[3]) and not {9, 10, 11} & set(got)
    assert X.page_scores(docs(spark, [])).count() == 0


def test_packing_bounds():
    rng = random.Random(9)
    for _ in range(60):
        cap = rng.randrange(6, 14)
        sizes = np.array([rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 8))])

        def best(left, boxes):
            if not left:
                return len(boxes)
            tried, out = set(), 99
            for i, b in enumerate(boxes):
                if b + left[0] <= cap and b not in tried:
                    tried.add(b)
                    out = min(out, best(left[1:], boxes[:i] + [b + left[0]] + boxes[i + 1 :]))
            return min(out, best(left[1:], [*boxes, left[0]])) if len(boxes) < out else out

        opt = best(sorted(sizes.tolist(), reverse=True), [])
        box = P.best_fit_decreasing(sizes, cap)
        assert np.bincount(box, weights=sizes).max() <= cap
        assert P.lower_bound(sizes, cap) <= opt <= box.max() + 1
    assert P.lower_bound(np.array([], int), 10) == 0 and P.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_containers(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 100, 64, 300, rng.randrange(1, 90)])) for i in range(2000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    rows = P.containers(df, capacity=100, part_items=150).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    for i, n in sizes:
        got = [t for _, t in sorted(by.get(i, []))]
        assert sum(got) == n and (len(got) <= 1 or n > 100)
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 100 and all(r.fill == fill[r.container] and r.part_boxes >= r.part_bound for r in rows)
    c = P.packing_certificate(spark.createDataFrame(rows), 100).first()
    assert c.containers == len(fill) and 0 <= c.gap <= 0.02 * c.containers
    assert P.containers(df.limit(0), 100).count() == 0


def test_certified_containers():
    rng = random.Random(4)
    for _ in range(40):
        cap = rng.randrange(10, 60)
        sizes = np.array([rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 60))])
        box = P.best_fit_decreasing(sizes, cap)
        fill = np.bincount(box, weights=sizes).astype(int)
        kept = P.certified(sizes, box, fill, cap)
        assert P.lower_bound(sizes[np.isin(box, kept)], cap) == len(kept)
        if P.lower_bound(sizes, cap) == len(fill):
            assert len(kept) == len(fill)


def test_partitions_with_a_gap_exchange(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([34, 35, 51, 52, 7])) for i in range(600)], "doc_id bigint, tokens bigint")
    rows = P.containers(df, capacity=100, part_items=60).collect()
    assert {r.round for r in rows} > {1}
    last = max(r.round for r in rows)
    assert all(r.part_boxes <= r.part_bound for r in rows if r.round < last)  # closed early only where the bound shows them to be needed
    fill = {r.container: r.fill for r in rows}
    assert len(fill) <= len({r.container for r in P.containers(df, capacity=100, part_items=60, max_rounds=1).collect()})
    c = P.packing_certificate(spark.createDataFrame(rows), 100).first()
    assert c.rounds == last and c.partitions >= c.certified > 0


def test_token_counts(spark):
    got = {r.doc_id: r.tokens for r in P.token_counts(docs(spark, [(1, "hello world"), (1, "hello world"), (2, ""), (3, " \n"), (4, None), (5, "<|endoftext|>" * 500)])).collect()}
    assert set(got) == {1, 5} and 1 < got[1] < 5 and got[5] > 500
