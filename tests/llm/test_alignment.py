"""Token alignment against a version that compares byte ranges token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheeltrace.llm import alignment, base, registry


@pytest.fixture(scope="module")
def exact():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in keep]
    back = {chr(c): c for c in keep} | {chr(256 + i): c for i, c in enumerate(rest)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(text):
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        return left, right

    return tokens


def brute(rows, tokens):
    """Rows (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)."""
    found, count = [], Counter()
    for i, text in rows:
        text = text or ""
        a, b = tokens(text) if text else ([], [])
        want = b" " + text.encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        groups, ia, ib = [], 0, 0
        while ia < len(a):
            left, right, na, nb = [], [], 0, 0
            while not left or na != nb:
                if na <= nb:
                    left.append(a[ia][0])
                    na += len(a[ia][1])
                    ia += 1
                else:
                    right.append(b[ib][0])
                    nb += len(b[ib][1])
                    ib += 1
            groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        count.update(links.keys())
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, na, nb, g, sum(links.values()), sha, sum(n for (x, y), n in links.items() if count[x, y] == top[x]), sum(n * count[p] for p, n in links.items())) for i, na, nb, g, links, sha in found]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, data, exact):
    rows = [tuple(r) for r in base.table(spark, data, "documents").select("doc_id", "text").collect()]
    df = registry.QUERIES["op13_token_alignment"](spark, data)
    assert set(COLUMNS) <= set(df.columns) and got(df) == sorted(brute(rows, exact), key=str)


ODD = [
    (1, "the cat  sat"), (1, "the cat  sat"), (2, None), (3, ""), (None, "null id 123"), (None, None), (4, " "), (5, "   \n\t \r\n"), (6, "<|endoftext|> <s></s> <unk> <0x41> ▁ a▁b"), (7, "日本語のテキスト 😀👨‍👩‍👧 é é ﬁ Ａ"),
    (8, "\x00\x01 \x7f ​﻿ "), (9, "a" * 3_000), (10, " " * 5_000 + "x"), (11, "ab" * 2_000 + "😀" * 500), (12, "1234567890" * 50), (13, "word " * 40_000), (14, "don't 'S we'll"),
]


@pytest.mark.parametrize("block", (1, 3_000, alignment.BLOCK_CHARS))
def test_odd_rows_in_blocks(spark, exact, block):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "pairs", "n_a", "keys", "texts", "_text", "times")}).repartition(3)
    assert got(alignment.linked(docs, block_chars=block)) == sorted(brute(ODD, exact), key=str)
    assert alignment.linked(docs.filter("false")).count() == 0


def test_random_texts(spark, exact):
    rng = random.Random(4)
    marks = [" ", "  ", "\n", "a", "the", "é", "ß", "中", "😀", "́", "0", "'s", "<s>", "▁", "\t", ".", "Ing", "http://"]
    rows = [(i, "".join(rng.choices(marks, k=rng.randrange(1, 60)))) for i in range(400)]
    assert got(alignment.linked(spark.createDataFrame(rows, "doc_id long, text string"), block_chars=500)) == sorted(brute(rows, exact), key=str)


def test_rank_counts_marks():
    rng = np.random.default_rng(1)
    ends = np.unique(rng.integers(1, 1_000, 300))
    bits, cuts = alignment.bitset(ends, 1_000), np.array([0, 1, 63, 64, 65, 127, 128, 999, 1_000])
    assert alignment.rank(bits, cuts).tolist() == [int((ends <= c).sum()) for c in cuts]


def test_large_groups_count_links_by_ids():
    one = np.arange(200) % 3
    lined = alignment.Aligned.of(one, one + 5, np.full(200, 7), np.r_[np.full(199, 6), 206])
    for most in (0, 10**9):
        group, key, times = lined.pairs(most)
        total = Counter()
        for k, n in zip(key.tolist(), times.tolist()):
            total[k] += n
        if most == 0:
            want = total
    assert total == want and sum(total.values()) == int(np.prod(lined.widths(), axis=0).sum())
