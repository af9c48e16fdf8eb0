"""op12: against token by token work with the other library's tokenizer."""

import hashlib
from collections import Counter

import pytest
from edges import documents, nothing

from tideview.llm import queries, tokenalign


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    signs = tokenalign._byte_signs()

    def pieces(text):
        left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:-1], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if not text or b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            return [], []
        return left, right

    return pieces


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows, pieces):
    """Sorted (doc_id, measures) of rows (doc_id, text)."""
    each, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, pieces(text or ""))
        pairs, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                pairs.append((i, b[k][0]))
                k += 1
        counts.update(set(pairs))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, _ in a if low <= s < end) + "|" + ",".join(str(i) for i, s, _ in b if low <= s < end))
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        each.append((doc_id, len(a), len(b), len(groups), pairs, digest))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        ((d, n_a, n_b, g, len(p), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), s) for d, n_a, n_b, g, p, s in each), key=repr
    )


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_small_texts_in_small_chunks(spark, encoders):
    texts = [
        "The cat sat on the mat.", "the cat", None, "", " ", "  two  spaces ", "it's \n\n ok\t\tx", "a▁b", "▁", "<|endoftext|> <s> </s> <unk>", "naïve Ångström",
        "日本語テキスト 🙂👩‍👩‍👧", "x" * 300, "0123456789", "a\x00b", "\r\n", "ﬁne", "don't I'M", "the cat", "the cat", "ééé",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "the cat"), (None, "the cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk in (1, 40, 1 << 20):
        assert got(tokenalign.align(df, chunk=chunk)) == brute(rows, encoders)


def test_edges(spark, encoders):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if len(r.text or "") < 5000]
    assert got(tokenalign.align(df.where("text is null or length(text) < 5000"))) == brute(rows, encoders)
    assert tokenalign.align(df).count() == df.count()
    assert tokenalign.align(nothing(spark)).collect() == []


def test_invalid_utf8_has_no_tokens(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('41FF42') as string) as text union all select 2L, 'ok'")
    rows = {r.doc_id: r for r in tokenalign.align(df).collect()}
    assert rows[1].n_a == rows[1].n_links == 0 and rows[1].groups_sha256 == "" and rows[2].n_a == 1


def test_query_on_the_given_table(spark, encoders):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_align(spark, sf)) == brute(rows, encoders)
