"""Column functions on small literal tables, and against brute force on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lutrin.functions import answers as A
from lutrin.functions import lexicon as L
from lutrin.functions import nlp
from lutrin.functions import text as T
from lutrin.operators import context as C
from lutrin.sources import files


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_word_lists():
    stop, nouns = set(L.STOPWORDS), set(L.DOMAIN_NOUNS)
    assert {"les", "auraient", "voudrions", "combien", "pourrez", "the"} <= stop
    assert {"plateaux", "cristaux", "jetons", "bois"} <= nouns
    assert stop & nouns == {"pouvoir"}


def test_query_text_keeps_accents(spark):
    rows = [("Combien de règles pour la défausse ?",), ("Et de la ?",), ("Le pouvoir du roi, pouvoir du ROI",)]
    got = values(spark, rows, "q string", nlp.query_text(F.col("q")), nlp.query_terms(F.col("q"))["mode"])
    assert got == [("règles or défausse", "any"), ("Et de la ?", "all"), ("pouvoir or roi", "any")]


HEADINGS = [
    ("TOUR DE JEU", "La mise en place est finie.", "Un tour a 5 phases.", True),
    ("Mise en place", "", "Chacun prend un plateau.", True),
    ("2. PHASE D'ACTION", "", "Le premier joueur…", True),
    ("Le joueur actif pioche", "", "deux cartes.", False),
    ("Le joueur actif pioche", "Il commence.", "Deux cartes.", False),
    ("MISSION", "au plus 3 cartes", "en main.", False),
    ("Fin de partie.", "", "Le joueur…", False),
    ("1. Piocher deux cartes", "", "Puis jouer.", False),
    ("Mines (gris) : voir pages 9 à 11", "", "Navires", False),
    ("4 joueurs : 2 boucliers", "", "", False),
    ("H 55h", "", "Animal", False),
    ("Les tuiles Monastère", "", "Le jeu inclut 26 tuiles.", True),
]


def test_heading_cases(spark):
    rows = [(i, *h[:3]) for i, h in enumerate(HEADINGS)]
    got = values(spark, rows, "i int, line string, prev string, next string", "i",
                 T.is_heading(F.col("line"), F.col("prev"), F.col("next")))
    assert dict(got) == {i: h[3] for i, h in enumerate(HEADINGS)}


def brute_split(text, size):
    pieces, rest = [], text
    while rest:
        if len(rest) <= size:
            cut = len(rest)
        else:
            ends = [k for k in range(size * 2 // 3, size + 1)
                    if rest[k] in ".!?" and (k + 1 == len(rest) or rest[k + 1] in " \n")]
            spaces = [k for k in range(size // 2, size + 1) if rest[k] in " \n"]
            cut = ends[-1] + 1 if ends else spaces[-1] if spaces else size
        pieces.append(rest[:cut].strip())
        rest = rest[cut:].lstrip(" \n")
    return [p for p in pieces if p]


def test_long_paragraphs_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é." if rng.random() < 0.5 else "abcdef \n!") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    texts += ["x" * 95, "a. " * 60, " " * 30, "é" * 61 + ". b"]
    got = values(spark, [(t,) for t in texts], "t string", "t", T.split_long(F.col("t"), 30))
    assert all(pieces == brute_split(t, 30) for t, pieces in got)


def test_pages_keep_their_numbers(spark):
    text = "un\n- 1 -\nmot cou-\npé   ici\f \f3\f\n\n\nfin\n\n\n\nsuite"
    (pages,) = values(spark, [(text,)], "t string", T.split_pages(F.col("t")))[0]
    assert [tuple(p) for p in pages] == [(1, "un\nmot coupé ici"), (4, "fin\n\nsuite")]
    (empty,) = values(spark, [("  \f ",)], "t string", T.split_pages(F.col("t")))[0]
    assert [tuple(p) for p in empty] == [(1, "")]


def test_repeated_lines_and_noise(spark):
    page = "Mon livret\nRègle {}\nIndex .... 12\nTexte"
    text = "\f".join(page.format(i) for i in range(5))
    (headers,) = values(spark, [(text,)], "t string", T.repeated_lines(T.split_pages(F.col("t"))))[0]
    assert sorted(headers) == ["Index .... 12", "Mon livret", "Texte"]


@pytest.mark.parametrize("name,want", [
    ("../../app/x.pdf", "x.pdf"), (r"..\..\app\x.pdf", "x.pdf"), ("..", "file."), ("règles du jeu.pdf", "regles_du_jeu.pdf"),
    ("x.p/df", "df"), ('rules.pdf"; foo=bar', "rules.pdf_foo_bar")])
def test_safe_file_names(spark, name, want):
    assert values(spark, [(name,)], "n string", T.safe_file_name(F.col("n"))) == [(want,)]


def test_sniffed_formats(spark):
    rows = [(b"%PDF-1.7\n", "download"), (b"%PDF-1.4", "regles.txt"), ("# Règles".encode(), "regles.md"),
            ("Règles du jeu".encode(), "download"), (b"<!DOCTYPE html><html>", "page"), (b"PK\x03\x04", "a.zip")]
    got = values(spark, rows, "head binary, name string", files.sniffed_format(F.col("head"), F.col("name")))
    assert [g[0] for g in got] == [".pdf", ".pdf", ".md", ".txt", None, None]


def test_download_names(spark):
    rows = [("https://x.fr/files/regles.pdf?v=2", ""), ("https://x.fr/download?id=3", ""), ("https://x.fr/", ""),
            ("https://x.fr/d", "attachment; filename=\"a.pdf\"; filename*=UTF-8''r%C3%A8gles.pdf"),
            ("https://x.fr/d", 'attachment; filename="a.pdf"')]
    got = values(spark, rows, "url string, d string", files.download_name(F.col("url"), F.col("d")))
    assert [g[0] for g in got] == ["regles.pdf", "download", "downloaded-file", "règles.pdf", "a.pdf"]


FACTS = [
    ("**Au plus 3 cartes MISSION** en main.", "3|trois", True), ("Trois cartes au plus.", "3|trois", True),
    ("Il faut 13 cartes.", "3|trois", False), ("Après la 4e Époque.", "quatrième|4e", True),
    ("Le dé « déjà vu »", "déjà vu", True), ("On paie avec des cubes R&D.", "r&d", True),
    ("Elle n’est jamais contrôlée.", "jamais contrôlée", True), ("La réserve du joueur.", "réserves", False),
    ("**Au plus 2 cartes** (p. 3)", "3|trois", False),
]


def test_facts_are_whole_words(spark):
    got = values(spark, [f[:2] for f in FACTS], "a string, f string", A.missing_facts(F.col("a"), F.array("f")))
    assert [not g[0] for g in got] == [f[2] for f in FACTS]


def test_cited_pages(spark):
    rows = [("**3 cartes** (p. 6)",), ("Voir p.4-5 et page 12.",), ("pages 3 à 5",), ("(p. 6) puis (p. 6)",), ("Aucune page, 3 cartes.",)]
    got = values(spark, rows, "a string", A.cited_pages(F.col("a")))
    assert [g[0] for g in got] == [[6], [4, 5, 12], [3, 5], [6], []]


def test_filler_and_content(spark):
    rows = [("Ok, on pioche.",), ("D'accord.\n**Non** (p. 3).",), ("Okapi : carte.",), ("Oui (p. 1).",), ("Ok.",)]
    got = values(spark, rows, "a string", A.without_filler(F.col("a")))
    assert [g[0] for g in got] == ["on pioche.", "**Non** (p. 3).", "Okapi : carte.", "Oui (p. 1).", "Ok."]
    raw = [('"texte"',), ('[{"type":"thinking","text":"x"},{"type":"text","text":"a"},{"type":"text","text":"b"}]',), ("null",), (None,), ("12",)]
    assert [g[0] for g in values(spark, raw, "r string", A.content_text(F.col("r")))] == ["texte", "ab", "", "", None]


def test_refusal_words_and_ranges(spark):
    rows = [("**Je ne  trouve pas** cette règle.", 4, 5), ("Oui.", None, None)]
    got = values(spark, rows, "a string, s int, e int", A.is_refusal(F.col("a")), A.word_count(F.col("a")),
                 A.page_range_text(F.col("s"), F.col("e")), C.page_reference(F.col("s"), F.col("e")))
    assert got == [(True, 6, "4-5", "p. 4-5"), (False, 1, "?", "")]
    pages = [(None, None), (0, 0), (4, None), (4, 4), (4, 5)]
    got = values(spark, pages, "s int, e int", C.page_reference(F.col("s"), F.col("e")))
    assert [g[0] for g in got] == ["", "", "p. 4", "p. 4", "p. 4-5"]


SECTION = "array<struct<passage_id:string,title:string,text:string,page_start:int,page_end:int,hierarchy_path:string>>"


def sections(*items):
    return [[tuple(i) for i in items]]


def test_context_groups_by_chapter(spark):
    rows = [(sections(
        ("a", "Attaque seul", "A…", 7, 8, "SOLO > Combat"), ("b", "Attaque", "B…", None, None, "MULTI > Combat"),
        ("c", "Défense seul", "C…", 3, None, "SOLO > Combat"), ("d", "Fin", "D…", None, None, ""))[0],)]
    (text,) = values(spark, rows, f"s {SECTION}", C.context_text(F.col("s")))[0]
    assert text == ("Chapitre : SOLO > Combat\n\nSection 1: Attaque seul (p. 7-8)\nA…\n\nSection 2: Défense seul (p. 3)\nC…"
                    "\n\nChapitre : MULTI > Combat\n\nSection 3: Attaque\nB…\n\nSection 4: Fin\nD…")


@pytest.mark.parametrize("lengths,want", [([3300, 3300, 1000, 400], "abd"), ([7001, 10], "a"), ([], "")])
def test_context_budget(spark, lengths, want):
    items = [(chr(97 + i), "", "x" * n, None, None, "") for i, n in enumerate(lengths)]
    (kept,) = values(spark, [(items,)], f"s {SECTION}", C.fit_budget(F.col("s")))[0]
    assert "".join(k["passage_id"] for k in kept) == want


def test_history_is_trimmed(spark):
    turns = [("Q1", "A1"), ("Q2", "A2"), (" ", "A"), ("Q3", "A3"), ("Q4", "x" * 5000), ("Q5", "")]
    (kept,) = values(spark, [(turns,)], "h array<struct<question:string,answer:string>>", C.trimmed_history(F.col("h")))[0]
    assert [k["question"] for k in kept] == ["Q2", "Q3", "Q4"]
    assert len(kept[-1]["answer"]) == 2001
    (none,) = values(spark, [([],)], "h array<struct<question:string,answer:string>>", C.trimmed_history(F.col("h")))[0]
    assert none == []


def test_mechanics_by_word(spark):
    rows = [("Un bord net. ÉLIMINATION directe.",), ("Payez un or.",), ("Le joueur ne prend pas la tuile",), ("Lancez un DÉ !",),
            ("Il reste 2 PA par manche de jeu",)]
    loose = values(spark, rows, "t string", nlp.mechanics(F.col("t")))
    exact = values(spark, rows, "t string", nlp.mechanics(F.col("t"), match="word"))
    assert loose == [(["player_elimination"],), (["resource_management"],), (["tile_placement"],), (["dice_rolling"],), (["action_points"],)]
    assert exact[:2] == loose[:2]


def test_fixed_lists_typed_here(spark):
    rows = [("Le plateau des trésors est très grand, bois et fer",), ("Combien de bonus pourrait-on gagner ?",), ("An ox in it",)]
    got = values(spark, rows, "t string", nlp.keywords(F.col("t")))
    assert got == [(["plateau", "tresors", "grand", "bois", "fer"],), (["bonus", "gagner"],), ([],)]
    assert (len(L.STOPWORDS), len(L.DOMAIN_NOUNS)) == (450, 264)


def test_plural_and_singular_share_a_stem(spark):
    pairs = [("cartes", "carte"), ("chevaux", "cheval"), ("règles", "règle"), ("joueurs", "joueur"), ("piochées", "pioché")]
    got = values(spark, pairs, "a string, b string", nlp.stem(F.col("a")) == nlp.stem(F.col("b")))
    assert all(g[0] for g in got)


def test_batch_stems_equal_the_column_rules(spark):
    from lutrin.functions import stems

    texts = ["Les chevaux royaux ÉTÉ été étés donnée donnés mer mers aaa classe", "", None, "l'île 12 x2 Ærø ﬁn İstanbul ΑΣ ²x ab_cd balle balles"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {r["i"]: r["s"] for r in df.select("i", nlp.text_stems(F.col("t")).alias("s")).collect()}
    batch = df.select("i", stems.split_words(F.col("t")).alias("w")).toArrow().combine_chunks()
    rows, codes, names = stems.stemmed(batch["w"].combine_chunks())
    ids = batch["i"].to_pylist()
    got = {i: [] for i in ids}
    for row, code in zip(rows.tolist(), codes.tolist(), strict=True):
        got[ids[row]].append(names[code])
    assert got == want and len(want[0]) > 5


def test_batch_topics_equal_the_column_rules(spark):
    from lutrin.functions import topics

    rng = random.Random(11)
    words = [k for _, (_, ks) in L.MECHANICS.items() for k in ks] + ["OR", "pa", "DÉS", "mot", "2"]
    signs = [*" \n\t'.-²½aé·ªʰͰ日́\u0085\x00", "\U0001d400", "\U0001f600", " ", " "]
    texts = ["".join(rng.choice(words if rng.random() < 0.4 else signs) for _ in range(rng.choice([0, 1, 3, 9, 40]))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "\U0001d400or", "日or", "oŕ", "payer or, PA"]], "t string")
    got = df.select("t", nlp.mechanics(F.col("t")).alias("want"), topics.mechanics(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got) and len({tuple(r["got"]) for r in got}) > 50
    assert [x for x in topics.tags_of(["日or".encode(), "\U0001d400or".encode(), b"or ", b"bord", None])] == [
        ["?resource_management"], ["?resource_management"], ["resource_management"], [], []]


def test_summary_and_quality_by_brute_force(spark):
    rng = random.Random(12)
    signs = [*"abé.!?\n '-…2", "\n\n", "\n\n\n", "  ", "mots", "Σ", "\U0001f600", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 4, 12, 60, 300]))) for _ in range(1500)] + ["--", "a -- b", "ΑΣ' ΑΣ", "", ". a"]

    def summary(t):
        t = t.strip(L.SPACE)
        ends = [i + n for i in range(1, len(t)) for n, at in ((1, t[i] in ".!?"), (2, t[i:i + 2] == "\n\n")) if at]
        first = t[:1] if t[:1] in tuple(".!?") else t[:min(ends)] if ends else ""
        if first:
            return first.strip(L.SPACE)[:220]
        head = t[:220]
        return t if len(t) <= 220 else (head[:head.rindex(" ")] if " " in head[111:] else head).strip(L.SPACE) + "…"

    def low(t):
        t = t.strip(L.SPACE)
        if not t or sum(c.isalpha() for c in t) < len(t) * 0.45:
            return True
        some = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in re.split(r"[\s ]+", t) if w][:30]
        return sum(len(w) <= 2 for w in some) > len(some) * 0.6 or (len(some) >= 10 and len(set(some)) < 5)

    got = values(spark, [(t,) for t in texts], "t string", "t", T.summary(F.col("t")), T.is_low_quality(F.col("t")))
    assert [g[1] for g in got] == [summary(g[0]) for g in got]
    assert [g[2] for g in got] == [low(g[0]) for g in got]


def test_description_searches_few_patterns(spark):
    """Fixed words are looked up without patterns, topics in batches, and the first sentence is found once."""
    from lutrin.operators import passages as P

    form = "collection_id string, doc_id long, chunk_index int, total_chunks int, text string, page_start int, page_end int, hierarchy_path string"
    plan = P.enriched(spark.createDataFrame([], form))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "mise en place|" not in plan
    assert plan.count("regexp_extract(") == 2  # the first sentence and the last space
