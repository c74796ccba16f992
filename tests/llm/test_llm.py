"""Tokens against the public library, mixes against their definition, sentences against marked texts."""

import math
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing, sentences, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.TOKENIZER), reason="no tokenizer here")
TEXTS = [None, "", " ", "  \n\n x", "Hello world's 123 're", "<|endoftext|> é中文 🧬👩‍🔬 नमस्ते", "a" * 5000, "=-" * 3000, "ACGT" * 2000, "\x1c\x1d a\x85b\xa0c", "ﬁ ½ Ⅳ İstanbul"]


@pytest.fixture(scope="module")
def transducer():
    with open(tokenizer.TOKENIZER, "rb") as f:
        return tokenizer.Transducer(tokenizer.read_ranks(f.read()))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = defaultdict(list)
    for r in tokenizer.encode_texts(df, "doc_id", "text").collect():
        got[r["doc_id"]].append(r["ids"])
    assert got[0] == [[], []] and all(got[i] == [library(t or "")] for i, t in enumerate(TEXTS) if i)
    assert tokenizer.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    sizes = {r["doc_id"]: r["tokens"] for r in tokenizer.token_sizes(df.drop("ids"), ["doc_id"], "text").collect()}
    assert sizes[4] == len(library(TEXTS[4])) and sizes[0] == 0


def test_random_words(transducer, library):
    r = random.Random(11)
    parts = ["a", "b", "the", " ", "-", "=", "0", "er", "in", "ing", "\n", "é", "中", "th", "'s", "_", "ت"]
    for _ in range(1500):
        text = "".join(r.choices(r.sample(parts, r.randint(1, 5)), k=r.randint(1, 200)))
        ids = transducer.encode(text)
        assert ids == library(text) and tokenizer.decode(transducer, ids) == text


def test_stream_is_bounded(transducer):
    """A long word gives its tokens while it is still being read, and what is held stays small."""
    word, out, fed = b"ab" * 20_000, 0, 0

    def feed():
        nonlocal fed
        for i in range(0, len(word), 100):
            fed = i
            yield word[i : i + 100]

    first = None
    for _ in transducer.stream(feed()):
        first = fed if first is None else first
        out += 1
    assert first < 8 * transducer.longest and out > 1000
    live, bound = transducer.lookahead()
    assert live == transducer.longest - 1 and bound > live


def test_lookahead_of_a_small_merge_list():
    """Behind the sufficient lookahead tokens are emitted even while the live paths differ; the result stays that of merging."""
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aab": 257, b"ba": 258, b"aaaa": 259}
    t = tokenizer.Transducer(ranks)
    assert (t.live, t.bound) == (3, 16)
    r = random.Random(12)
    for _ in range(300):
        word = bytes(r.choices(b"aab", k=r.randint(1, 200)))
        assert list(t.stream([word])) == t.merge(word)
    held = []
    plain = t.shared
    t.shared = lambda back, n, live, last: held.append(n) or 0  # as if the live paths never met
    assert list(t.stream([b"aab" * 500])) == t.merge(b"aab" * 500) and max(held) <= t.bound + 4 * (t.live + 1) + 4
    t.shared = plain


def test_other_files(transducer):
    with pytest.raises(ValueError):
        tokenizer.read_ranks(b'{"version": "1.0"}')
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = tokenizer.read_ranks(f.read())
    other, own = tokenizer.Transducer(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert public_tokenizers.PATTERN == tokenizer.PATTERN
    assert all(other.encode(x or "") == own.encode_ordinary(x or "") for x in TEXTS if x is None or "\x1c" not in x)


def test_decoder():
    m = tokenizer.Utf8()
    r = random.Random(3)
    for _ in range(3000):
        data = bytes(r.choices([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0xA7, 0xAC, 0xED, 0xA0, 0xFF, 0xF4, 0x90], k=r.randint(0, 9)))
        assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.close() == data.decode("utf-8", "replace")


def mix(spark, docs, targets):
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int")


def test_mixing(spark, library):
    r = random.Random(5)
    words = "the exon table of genes is sorted by base and strand".split()
    docs = [(i, r.choice(["big"] * 8 + [" Small", "SMALL", None]), r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 60)))])) for i in range(1500)]
    targets = [("m", "Big", 3.0, 2), ("m", "small ", 1.0, 3), ("n", "small", 0.9, 2), ("n", "big", 0.1, 1), ("n", "nowhere", 0.2, 9), ("o", "big", None, None), ("o", None, 1.0, 2), ("p", "nowhere", 1.0, 1)]
    d, t = mix(spark, docs, targets)
    sized, histogram, solved = mixing.balance(d, t)
    goals = [r.asDict() for r in solved.collect()]
    have = defaultdict(int)
    for _, s, x in docs:
        have[(s or "?").strip().lower()] += len(library(x or ""))
    for g in goals:
        own = [x for x in targets if x[0] == g["mix_id"]]
        size = sum(have.get(s, 0) for s in {(x[1] or "??").strip().lower() for x in own})
        assert g["want"] == pytest.approx(g["share"] * size) and g["reachable"] == (not g["cap"] * g["have"] < g["want"])
        assert (g["x"] == math.inf) == (not g["reachable"])
    assert sorted(str((g["mix_id"], g["source"])) for g in goals if not g["reachable"]) == ["('n', 'nowhere')", "('n', 'small')", "('o', None)"]
    taken = mixing.copies(sized, histogram, solved).collect()
    assert sorted(map(str, taken)) == sorted(map(str, mixing.copies(sized.repartition(7), histogram, solved).collect()))
    got = defaultdict(lambda: [0, 0])
    for x in taken:
        got[x["mix_id"], x["source"]][0] += x["copies"] * x["tokens"]
        got[x["mix_id"], x["source"]][1] = max(got[x["mix_id"], x["source"]][1], x["copies"])
    for g in goals:
        tokens, most = got[g["mix_id"], g["source"]]
        assert most <= g["cap"]
        if g["source"] and g["have"]:
            longest = max(len(library(x or "")) for _, s, x in docs if (s or "?").strip().lower() == g["source"])
            assert abs(tokens - g["aim"]) <= (longest if g["reachable"] else 0)
    # the rates solve the constraint exactly, before they are rounded
    sizes = [len(library(x or "")) for _, s, x in docs if s == "big"]
    g = next(g for g in goals if (g["mix_id"], g["source"]) == ("m", "big"))
    assert sum(n * min(g["cap"], math.exp(g["x"] * n / g["mean"])) for n in sizes) == pytest.approx(g["want"], rel=1e-6)
    report = {(r["mix_id"], r["source"]): r for r in mixing.shares(sized, histogram, solved).collect()}
    assert len(report) == len(targets)
    # a source that falls short doesn't move the shares of the others
    for which in "mn":
        for g in goals:
            if g["mix_id"] == which and g["reachable"]:
                assert report[which, g["source"]]["reached_share"] == pytest.approx(g["share"], rel=0.01)
    none = mixing.balance(d.limit(0), t)
    assert none[2].agg(F.max("have")).first()[0] == 0 and mixing.copies(*none).count() == 0
    assert mixing.balance(d, t.limit(0))[2].count() == 0


def test_mixing_many_targets(spark):
    """Targets are rows of a table: there is no limit on their number."""
    sizes = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 20).cast("string").alias("source"), (F.col("id") % 13 + 1).alias("tokens"))
    targets = spark.range(3000).select((F.col("id") / 5).cast("int").cast("string").alias("mix_id"), (F.col("id") % 20).cast("string").alias("source"), F.lit(1.0).alias("target_share"), F.lit(4).alias("max_repeats"))
    solved = mixing.solve(targets, mixing.lengths(sizes))
    assert solved.count() == 3000 and solved.where("reachable = (cap * have < want)").count() == 0


#: Sentences between ¶ signs; what stands between other signs ¦ lies outside.
MARKED = [
    ("en", '¶"Does it index first?" asked Corvie.¶ ¶[b]Opening sites.v2.tsv in Txmerge gave exit code 987.[/b]¶ ¶The job ended at 4 a.m.¶ ¶At 5 p.m. Nadrik restarted the job.¶ ¶Chr. X gave 611 hits; each gene body looks fine.¶ ¶No. 658 in the list is wrong, e.g. that contig lacks the stop codon.¶'),
    ("en", "¶why?!¶ ¶it took approx. 73 min. on chr. 285 alone.¶  ¶the job ended at 4 a.m.¶ ¶With 22.649 as limit, the liftover step drops half the reads.¶ ¶the E.U. mirror was down.¶ ¶same here, 38.47 vs. 28.397.¶"),
    ("en", '¶A. Lunte and K. L. Quessa found the same.¶\n¶1. Who wrote "never trust a BAM"?¶\n¶2. It isn\'t our splice set, it\'s x1.fa.¶'),
    ("en", '> ¶Well... the old reference counts duplicates twice, and exonix is no better.¶ ¶&quot;Oh no... not again!&quot; cried Zimo.¶ ¶Thanks Oskin!!¶\n>\n¶No.¶  ¶Thanks Mirel!! :)¶ ¶We keep exons, introns, UTRs, etc.¶ ¶Does anyone know?¶'),
    ("en", '¶Zimo wrote: "Stop at pos. 183. Then restart." and left.¶ ¶The cutoff was 4.280.¶ ¶“It crashed again!” was all Peyla wrote.¶ ¶I waited and waited...¶ ¶Same here.¶'),
    ("en", "¶Corvie wrote: &quot;Stop at pos. 91. Then restart.&quot; &amp; left.¶ ¶I waited and waited...¶ ¶[b]Thanks![/b]¶"),
    ("en", "¶'Not my fault,' said Peyla. 🧬¶ ¶no. 466 in the list is wrong.¶ ¶(This is only true if the index fails.)¶ ¶The ratio (ca. 10.8) is too high.¶"),
    ("en", "¶It lacks the stop codon.¶¶Ask at https://forum.example/t/12?p=2.¶ ¶It's 12.9 s per read, max. 87 s.¶ ¶Visit http://docs.spancut.example/v7.1/index.html now!!!¶"),
    ("de", "¶Wir zählen Exons, Introns usw.¶ ¶Am 3. Mai lief es noch.¶ ¶Im 2. Lauf hat exonix 3.19 307 Stellen gefunden.¶ ¶Lunte schrieb: „Erst sortieren. Dann zählen.“¶ ¶Warum?¶ ¶»So nicht«, meinte Ashke.¶ ¶Das gilt z. B. für x1.fa.¶ ¶Wir nutzen ca. 11,98 GB, d. h. zu viel.¶"),
    ("es", "¶—¿Ya terminó? —preguntó Ilvo.¶ ¶La Sra. Ashke usa p. ej. mini.gtf.gz.¶ ¶«Nunca más», dijo Brunda.¶ ¶¿De verdad?¶ ¶Brunda escribió: «Primero ordena. Luego cuenta.»¶"),
    ("fr", "¶« C'est normal ? » a demandé Corvie.¶ ¶Attendez… l'index plante.¶ ¶Corvie a écrit : « Arrêtez tout. Relancez ensuite. »¶ ¶On a env. 146 sites, c.-à-d. trop.¶ ¶M. Zimo dit non.<br/>¶"),
    ("ru", "¶В 2023 г. было 208 тыс. сайтов.¶ ¶Мы взяли RiboFold, siteview и т. д.¶ ¶А. К. Мирель получил то же самое.¶ ¶«Оно вообще работает?» — спросил Тован.¶ ¶См. рис. 260 в x1.fa.¶"),
    ("el", "¶Γιατί ο πίνακας αποτυγχάνει;¶ ¶Ο κ. Μίρελ λέει ναι.¶ ¶«Δουλεύει;» ρώτησε η Άσκε.¶ ¶Δοκιμάστε π.χ. το x1.fa.¶"),
    ("ja", "¶えっと……索引は正常に見えます。¶¶「もう終わった。」とアシュケさんは書いた。¶¶トバンさんは「動きますか？」と聞いた。¶ ¶（この注釈がとても遅いです。）¶¶本当ですか！？¶"),
    ("zh", "¶阿什说：“先排序。再计数。”¶¶阈值是28.229。:-/¶¶“可以跑吗？”阿什问。¶¶地址是www.liftpad.example。;-)¶¶真的吗？！:)¶¶谢谢！:-/¶¶Orfly 2.1版太慢了。¶"),
    ("hi", '¶कृपया tmp.2.log देखें॥¶ ¶सीमा 25.1 है।¶ ¶"क्या यह चलता है?" तोवान ने पूछा।¶ ¶डॉ. मिरेल ने कहा।¶'),
    ("ar", "¶لماذا هذا الشرح يفشل؟¶ ¶«هل يعمل؟» سأل ميريل.¶ ¶قال د. ميريل ذلك.¶"),
    ("th", "¶ค่าที่ใช้คือ 10.7 เท่านั้น¶ ¶ขอบคุณมากครับ¶ ¶เราใช้ gapwalk 2.2.0 กับ 123 ตัวอย่าง¶"),
    (None, "--\n¶Corvie | Exon Lab¶\r\n• ¶Es waren Treffer.¶\r\n- ¶„Geht das überhaupt?“, fragte Werra.¶\n>> ¶x¶\n...\n"),
]


@pytest.mark.parametrize("i", range(len(MARKED)))
def test_sentences(i):
    lang, marked = MARKED[i]
    parts = marked.split("¶")
    text, want, at = "", [], 0
    for k, part in enumerate(parts):
        if k % 2 and part:
            want.append((len(text), len(text) + len(part)))
        text += part
    for hint in {lang, None, "xx"}:
        assert [text[a:b] for a, b in sentences.Splitter().split(text, hint)] == [text[a:b] for a, b in want]


#: Texts of no corpus here: one rule of the tables each.
UNPLANTED = [
    '"Stop!" Tom yelled.¶', '"No way!" Tom grumbled.¶', "Well, it ran.¶The plot was due in 5 m.¶It rained.¶", "We ran at 10 p.¶The end.¶", "Go to the U.S.¶Then return.¶", "The U.S. Army left.¶He saw K.L. Smith and J. R. R. Tolkien.¶",
    "Il sig. Rossi dice di no.¶La casa è bella.¶", "မင်္ဂလာပါ။¶နေကောင်းလား။¶", "He came at 5 p.m.¶The show began.¶", "By 6 p.m. Nora had left.¶", "Er kam am 3. Mai.¶Das ist z. B. Der Weg.¶", "See fig. 3.¶The end.¶See Fig. S1 for more.¶",
    "Mr. Smith vs. The State.¶It cost approx. $5.¶", "He left… and came back.¶Stop…¶The end.¶", "He works at Foo Inc.¶The firm is big.¶Foo Inc. is big.¶", "I like vitamin C.¶The doctor agreed.¶", '"I am done."¶The door closed.¶“Go!”¶She ran.¶',
    "Dr. 🙂 Smith left.¶Thanks! 🙂¶He said no.¶It is no. 7 of ten.¶", '"Really"? asked Tom.¶Yes.¶', "De heer dhr. Jansen is er niet.¶Wij wachten.¶", "Pan dr. Nowak nie jest w domu.¶To jest np. tutaj.¶",
]


@pytest.mark.parametrize("marked", UNPLANTED)
def test_sentences_of_other_texts(marked):
    want = [x for x in marked.split("¶") if x]
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences.Splitter().split(text)] == want


def test_sentences_look_back_as_far_as_needed():
    """The opening of a long quotation, a long tag and a long address count like short ones."""
    s = sentences.Splitter()
    inner = "It ran. It fell. " * 400
    for text in (f'"{inner}" asked Tom.', f'<b class="{"x" * 5000}">Dr. Smith left.</b>', f"See http://a.example/{'b!' * 3000}c for it."):
        assert [text[a:b] for a, b in s.split(text, "en")] == [text]
    text = "word, " * 1000 + "e.g. this one. Next."
    assert len(text) > 5000 and [text[a:b] for a, b in s.split(text, "en")] == [text[:-6], "Next."]
    text = f'<b class="{"x" * 5000}">A. Lunte left.</b> Next.'
    assert len(s.split(text, "en")) == 2


def test_index_of_the_tables_changes_nothing():
    """The rules alone decide like the rules behind the index that skips those which can't match."""
    r = random.Random(8)
    fast, slow = sentences.Splitter(), sentences.Splitter()
    slow.last_word = lambda *a: None
    parts = ["Dr", "fig", "e.g", "No", "U.S", "am 3", "x1.fa", "4.26", "z. B", "etc", "Tom", "ran", "p", "Ок", "г", "А", "дом", '"So', 'go"', "(it", "is)", "5 p.m", "well"]
    for _ in range(3000):
        text = " ".join(r.choice(parts) + r.choice(["", ".", ".", "!", "?", "...", "…", ".)", '."', ". :)"]) for _ in range(r.randint(1, 9)))
        lang = r.choice(["en", "de", "ru", None])
        assert fast.split(text, lang) == slow.split(text, lang), text


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en"), (2, None, None), (3, "", "en"), (4, " \n--\n", "en"), (5, "x", None), (5, "x", None), (6, "word " * 60_000, "en"), (7, "a. " * 20_000, "en")], "doc_id long, text string, lang string").withColumn("sent_start", F.lit("clash"))
    got = defaultdict(list)
    for r in sentences.sentences(df, "doc_id", "text", "lang").collect():
        got[r["doc_id"]].append((r["sent_start"], r["sent_end"]))
    assert sorted(got[1]) == [(0, 4), (5, 9)] and got[5] == [(0, 1), (0, 1)] and set(got) == {1, 5, 6, 7} and got[6] == [(0, 299_999)]
    assert sentences.sentences(df.limit(0), "doc_id", "text", "lang").count() == 0
