"""Chunking on small documents, and its folds against plain loops on random paragraphs."""

import random

from pyspark.sql import functions as F

from lutrin.operators import passages as P

PAGES = "collection_id string, doc_id int, pages array<struct<page_no:int,text:string>>"


def chunked(spark, pages):
    rows = P.passages(spark.createDataFrame([("c", 1, pages)], PAGES)).orderBy("chunk_index").collect()
    return rows


def test_page_ranges_cover_the_text(spark):
    def para(word):
        return ("Les joueurs posent leurs jetons " + word + " sur le plateau principal. ") * 7
    pages = [(1, para("rouges")), (2, para("bleus")), (4, para("verts") + "\n\n" + para("jaunes"))]
    rows = chunked(spark, pages)
    for number, text in pages:
        for row in rows:
            if text.strip()[:50] in row["text"]:
                assert row["page_start"] <= number <= row["page_end"]
    assert rows[-1]["page_end"] == 4
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_sentence_over_a_page_break(spark):
    pages = [(3, "Chacun reçoit des ressources au début du tour. " * 5 + "À la fin de la manche, chaque joueur"),
             (4, "défausse ses cartes restantes et en pioche cinq nouvelles pour la manche suivante.")]
    rows = chunked(spark, pages)
    assert [(r["page_start"], r["page_end"]) for r in rows] == [(3, 4)]


def test_headings_open_chapters(spark):
    rule = "Le joueur actif pioche deux cartes et les garde dans sa main. " * 4
    rows = chunked(spark, [(2, "MODE SOLO\n\nCombat\n" + rule), (5, "MODE MULTIJOUEUR\nCombat\n" + rule)])
    assert [r["hierarchy_path"] for r in rows] == ["MODE SOLO > Combat", "MODE MULTIJOUEUR > Combat"]
    assert rows[1]["text"].startswith("MODE MULTIJOUEUR")


def test_tiny_documents_stay_whole(spark):
    rows = chunked(spark, [(1, "Une règle très courte mais lisible."), (2, "Une deuxième règle tout aussi lisible.")])
    assert [(r["page_start"], r["page_end"], r["total_chunks"]) for r in rows] == [(1, 2, 1)]
    assert chunked(spark, [(1, ""), (2, "   ")]) == []


def loop_pack(paragraphs, size, minimum):
    """Plain greedy loop over (length, heading, upper) with a title per heading."""
    out, first, last, length, width, chapter, part = [], None, None, 0, 0, "", ""

    def path():
        return " > ".join(x for x in (chapter, part) if x)

    def flush():
        nonlocal first, length, width
        if first is not None and width >= minimum:
            out.append((first, last, path()))
        first, length, width = None, 0, 0

    for i, (n, heading, title) in enumerate(paragraphs):
        if heading:
            if length >= minimum:
                flush()
            if title == title.upper():
                chapter, part = title, ""
            else:
                part = title
        if n > 2 * size:
            flush()
            out.append((i, i, path()))
            continue
        if length > 0 and length + n > size:
            flush()
        width += n + (2 if length > 0 else 0)
        first = i if first is None else first
        last, length = i, length + n
    flush()
    return out


def test_packing_against_a_loop(spark):
    rng = random.Random(3)
    documents = []
    for d in range(40):
        paras = []
        for i in range(rng.randint(1, 25)):
            heading = rng.random() < 0.25
            if heading:
                text = f"PARTIE AAA{i}" if rng.random() < 0.5 else f"Section abc{i}"
            else:
                # each paragraph names its place, so a chunk tells what went into it
                text = f"p{i} " + " ".join(rng.choice(["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]) for _ in range(rng.randint(3, 30)))
            paras.append((text, i, i, heading))
        documents.append((d, paras))
    rows = spark.createDataFrame(documents, f"d int, p {P.PARAGRAPH}").select(
        "d", F.transform(P.pack(F.col("p"), 100, 40), lambda c: F.struct(
            c["page_start"].alias("a"), c["page_end"].alias("z"), c["hierarchy_path"].alias("path"))).alias("c")).collect()
    for d, chunks in rows:
        paras = dict(documents)[d]
        want = loop_pack([(len(t), h, t) for t, _, _, h in paras], 100, 40)
        assert [tuple(c) for c in chunks if c["a"] != c["z"] or len(paras[c["a"]][0]) <= 200] == [
            w for w in want if w[0] != w[1] or len(paras[w[0]][0]) <= 200]


def test_heading_chain_against_a_loop(spark):
    rng = random.Random(5)
    choices = ["TITRE HAUT", "Titre moyen", "une ligne basse", "Une phrase finie.", "AUTRE TITRE", "Suite ouverte,"]
    blocks = [[rng.choice(choices) for _ in range(rng.randint(1, 9))] for _ in range(120)]
    rows = spark.createDataFrame([(i, [(1, "\n".join(b))]) for i, b in enumerate(blocks)], "i int, pages array<struct<page_no:int,text:string>>")
    lines = P.block_lines(F.col("pages"), F.array().cast("array<string>"))
    got = dict(rows.select("i", F.transform(P.with_headings(lines), lambda x: x["heading"])).collect())

    def base(line, following):
        return line in ("TITRE HAUT", "Titre moyen", "AUTRE TITRE") and not (following or "X")[0].islower()

    for i, block in enumerate(blocks):
        want, previous = [], ""
        for j, line in enumerate(block):
            following = block[j + 1] if j + 1 < len(block) else None
            heading = base(line, following) and (previous == "" or (previous[-1] in ".!?:;" and line == line.upper()))
            want.append(heading)
            previous = "" if heading else line
        assert got[i] == want, block


def test_same_rows_for_any_partitioning(spark, folder):
    from lutrin.sources import tables as D

    docs = D.documents(spark, folder)
    one = P.enriched(P.passages(docs.coalesce(1))).collect()
    many = P.enriched(P.passages(docs.repartition(13))).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    ids = [r["passage_id"] for r in one]
    assert len(ids) == len(set(ids))


def test_gameplay_of_a_collection(spark):
    from lutrin.operators import enrich

    rows = [("a", 1, 0, "Mise en place : chacun prend cinq cartes. On mélange le tout."),
            ("a", 1, 1, "Le texte parle de tout.\n1. Lancer le sort\n- une seule fois\n2. Bouger son pion\n3. Finir le tour"),
            ("a", 2, 0, "Fin de partie : le vainqueur a le plus de jetons."), ("b", 3, 0, "Xyz.")]
    passages = spark.createDataFrame(rows, "collection_id string, doc_id int, chunk_index int, text string")
    found = enrich.gameplay(passages).withColumn("empty", enrich.is_empty_gameplay()).collect()
    (row,) = found
    assert row["collection_id"] == "a" and not row["empty"]
    assert row["setup"]["description"].startswith("Mise en place : chacun prend cinq cartes.")
    assert row["end_game"]["title"] == "Fin de partie" and row["turns"] is None
    assert [(p["order"], p["name"], p["steps"]) for p in row["phases"]] == [
        (1, "Lancer le sort", ["une seule fois"]), (2, "Bouger son pion", []), (3, "Finir le tour", [])]
    labels = [m["label"] for m in row["mechanics"]]
    assert labels == sorted(labels)
