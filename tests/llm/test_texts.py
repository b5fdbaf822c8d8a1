"""Tokens, chat and URL operators against libraries and brute force."""

from __future__ import annotations

import hashlib

import pytest
from helpers import of_duck, of_spark
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import bpe, chat, queries, token_count, url_rules

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "a ", "  x", "a  b\n\n  c<|endoftext|>d<|endoftext|>", "▁x ▁▁ y ", "\x00\x1c\x85  a​ é", "it's we'll 12 ½", "word " * 3000, "x" * 5000, None]


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(P.path("byte_bpe_50k.json"), size=20)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_equals_the_library(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_any_ids(coder, library):
    for ids in ([255, 200, 50256, 1], [], [50256]):
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, docs_of, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "  x")]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs_of(rows), P.path("byte_bpe_50k.json")).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(expected)
    back = bpe.decode(bpe.encode(docs_of(rows), P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"))
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.round_trip(docs_of([]), P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é▁ \n\t\r<s>\x00中  ")), max_size=40))
def test_piece_counts_equal_the_library(text):
    counter = token_count._counter(P.path("piece_bpe_32k.model"))
    assert counter.count([text]) == [len(counter.model.encode(text))]


@pytest.mark.parametrize("head", [token_count.HEAD, 3, 0])
def test_count_query(docs_of, monkeypatch, head):
    """Whether all pre-tokens go to the tasks, some, or none."""
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(token_count, "GATHERED", 4)
    model = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = [*enumerate(TEXTS), (3, "  x"), (3, "  x"), (None, "no id"), (50, "y" * 100_000 + " end")]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs_of(rows), P.path("piece_bpe_32k.model"), limit=3000, head=head).collect()]
    expected = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 3000) for i, t in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert token_count.count_tokens(docs_of([]), P.path("piece_bpe_32k.model"), head=head).count() == 0


def test_pretokens_are_counted_once(docs_of):
    words = token_count.vocabulary(docs_of([(i, f"all {i % 3} all") for i in range(9)] + [(9, None), (10, "")])).collect()
    assert {(r.token, r.n) for r in words} == {("all", 9), ("0", 3), ("1", 3), ("2", 3)} and len(words) == 4


def test_files_of_another_kind_are_errors(tmp_path):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}, {"model": spec["model"] | {"end_of_word_suffix": "</w>"}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.BytePairCoder(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.BytePairCoder(P.path("word_bpe_49k.json"))


def test_chat_query(spark, duck, sf_dir):
    assert of_spark(queries.op8_chat(spark, sf_dir)) == of_duck(duck, queries.ORACLES["op8_chat"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "&<|"]), st.lists(st.sampled_from([*"ab&;<|>\n", "<|im_end|>", "<|im_start|>", "&lt;|"]), max_size=12).map("".join)), max_size=6))
def test_chat_reads_back(turns):
    done = chat.render(turns)
    assert chat.read_back(done.text) == turns and not done.rewritten
    assert [chat.unescape(done.text[a:b]) for a, b in done.loss] == [t for r, t in turns if r == "assistant"]
    assert "".join(done.text[a:b] for a, b in done.spans) == done.text


def test_chat_finds_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"[{r}]" for r, _ in turns[:-1]) + (turns[-1][1] if turns else "")
    done = chat.render([("user", "hi"), ("assistant", "yes"), ("user", "bye")], last_only)
    assert done.rewritten and done.spans == [] and done.loss == []


def test_long_turns_are_not_remembered():
    chat._short_turn.cache_clear()
    turns = [("user", "x" * 100_000), ("assistant", "y" * 5000), ("user", "z")]
    assert chat.read_back(chat.render(turns).text) == turns and chat._short_turn.cache_info().currsize == 3  # the short turn and two probes


def test_chat_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", "y"), (1, 1, "assistant", "b", "x", "y")], "conv_id long, turn long, role string, text string, formatted string, n_turns string")
    assert [(r.n_turns, r.loss_chars) for r in chat.format_conversations(df).collect()] == [(2, 1)]


def test_chat_ties_nulls_and_texts(spark):
    rows = [(1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, 5, None, "x"), (1, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df, texts=True).collect()}
    assert chat.read_back(got[1].formatted) == [("system", "s"), ("assistant", "a"), ("assistant", "b"), ("user", "")]
    assert got[1].loss_chars == 2 and got[None].n_turns == 1 and len(got[1].spans) == 4
    assert chat.format_conversations(df.where("false")).count() == 0


def test_url_query(spark, duck, sf_dir):
    assert of_spark(queries.op4_url_rules(spark, sf_dir)) == of_duck(duck, queries.ORACLES["op4_url_rules"])


def test_urls_equal_all_rules_in_turn(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://example.com/en/", "http://badexample.com/en/", "ftp://a.net/es/?q=://b.com/", "http://a.net?x=/fr/", "http://net/fr/#a", "http://x.com:80/", "http://com/", "http://ÄX.com/"]
    rules = url_rules.RULES
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, None)], "page_id long, url string")
    for r in url_rules.judge(df, rules, "allow").collect():
        host, path = url_rules.split_url(urls[r.page_id])
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.name, best.verdict if best else "allow")
    assert url_rules.judge(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_rules_from_a_table_give_the_same(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_rules, "LISTED_RULES", 3)
    rules = [*url_rules.RULES, url_rules.Rule("net", "/es/", "allow"), url_rules.Rule("a.b", "/", "block"), url_rules.Rule("a.b", "/q+(x/", "allow"), url_rules.Rule("b", "/a\\Eb/", "block"), url_rules.Rule("b", "", "block")]
    urls = [None, "", "x", "http://", "http://a.b", "http://A.B/", "http://a.b/q+(x/y", "http://c.a.b/qx/", "http://b/a\\Eb/?", "http://b/a", "HTTP://WWW.Example.COM/en/x", "ftp://a.net/es/?q=://b.com/", "http://x.net/fr/é#a", "http://com/", "http://xa.b/"]
    df = spark.createDataFrame([(i, u, "own", "z") for i, u in enumerate(urls)] + [(1, None, "own", "z"), (5, urls[5], "own", "z")], "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, url_rules.judge(df, tuple(rules)).collect()), key=str)
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    expected = []
    for page, url in [*enumerate(urls), (1, None), (5, urls[5])]:
        host, path = url_rules.split_url(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.name, r.verdict), default=None)
        expected.append((page, host, path, best and best.name, best.verdict if best else "allow"))
    assert got == sorted(expected, key=str) == sorted(map(tuple, url_rules.judge_by_table(df, table).collect()), key=str)
    assert url_rules.judge_by_table(df.where("false"), table).count() == 0 and url_rules.judge(df, ()).where("rule is not null").count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rule = url_rules.Rule("example.com", "/en/", "block")
    assert list(url_rules.rule_index((rule,), {"h:com": 9, "h:example": 4, "p:en": 2})) == ["p:en"]
