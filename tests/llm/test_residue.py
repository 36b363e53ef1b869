import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pepspark.llm import residue as R

PROSE = [
    "The column was heated to 40 °C and washed for ten minutes before the next injection.",
    "Peptides were digested with trypsin over night and measured on an orbital trap in three runs.",
    "Die Proben wurden mit Trypsin verdaut und anschließend auf der Säule getrennt.",
    "We compared the mass error of both searches and found no difference between the groups.",
    "La columna se calentó antes de medir y el error de masa fue casi siempre menor.",
    "In ProForma the peptide is written as EM[Oxidation]EVTSES[Phospho]PEK with a charge of two.",
    'print("mass of %s" % total)',
    'for spectrum in reader("a.mzML"):\n    print(f"{spectrum.scan}: {spectrum.mz:.4f}")',
    "The report template marks the accession with {{accession}}, and the renderer replaces it later.",
    "The placeholder [SAMPLE] in older worksheets was replaced by the run number.",
    "When the mirror answered 404 Not Found for the file, we took the copy from the archive and read all spectra of it.",
    "The viewer of this tool needs JavaScript, so for this protein we describe the printed table in the text instead.",
    "Filler text such as lorem ipsum was used in the layout test, never in the entries on the proteins we describe here.",
    "SELECT peptide, count(*) FROM psms WHERE q_value <= 0.01 GROUP BY peptide",
]
RESIDUE = {
    "slot": ["Report for {{ sample }} prepared on {{ date }}.", "The run %RUN_TITLE% contains spectra of lung.", "Welcome, ${user}!", "Enzyme: (fill in)", "Sequence coverage rose from [INSERT SCORE HERE] to 40 %.", "Protein __GENE__ was found.", "See «protein name» for more."],
    "filler": ["Lorem ipsum dolor sit amet consectetur adipiscing elit.", "This is dummy text to fill the page.", "asdf qwer asdf test foo bar asdf"],
    "error": ["404 Not Found", "GATEWAY TIMEOUT", "Error 503: service unavailable", '{"status": 404, "error": "Not Found", "message": "The page you requested could not be found."}', "Diese Seite wurde leider nicht gefunden.", "Your session has expired. Please log in again."],
    "script": ["You need to enable JavaScript to view this page.", "Veuillez activer JavaScript pour afficher ce contenu.", "Für diese Seite müssen Skripte aktiviert sein."],
}


@pytest.fixture(scope="module")
def background():
    """Texts of the test data, for a natural model of ordinary size."""
    return [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t]


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(PROSE[:5] * 3) + "\n\n" + p, False) for i, p in enumerate(PROSE * 20)]
    for kind, texts in RESIDUE.items():
        for t in texts:
            out.append((len(out), t, True))
            out.append((len(out), PROSE[0] + "\n\n" + t + "\n\n" + PROSE[1], True))
    return out


def test_found_and_not_found(spark, rows, background):
    extra = [(90001, None, False), (90002, "", False), (90003, " \n\t ", False), (90004, PROSE[1] + " " + "A" * 200_000, False), (90005, "x" + "\n\n" + "403 Forbidden\n" + " ".join(PROSE[:6] * 2000), True)]
    df = spark.createDataFrame(rows + extra + rows[-1:] + [(-1, t, False) for t in background], "doc_id bigint, text string, kind boolean")
    found = {r.doc_id for r in R.residue_documents(df).collect()} - {-1}
    want = {i for i, _, bad in rows + extra if bad}
    text = {i: t for i, t, _ in rows + extra}
    assert not [text[i][:200] for i in found - want]
    assert not [text[i] for i in want - found]


def test_empty_table(spark):
    assert R.residue_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def counts_of(texts):
    total = None
    for buf, _, _ in R._slices(pa.array(texts, pa.large_string())):
        v = R.count_vectors(buf, once=True)
        total = v if total is None else [a + b for a, b in zip(total, v)]
    return total


def test_counts_cover_all_texts(spark):
    texts = ["abc def ghi", "xyz", None, "é" * 50, "a {{ b_c }} d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for got, want in zip(R.corpus_counts(df), counts_of([t for t in texts if t])):
        assert (got == want).all() and got.sum() > 0


def test_a_repeated_sentence_counts_once(spark):
    one = R.corpus_counts(spark.createDataFrame([(PROSE[0],)], "text string"))
    many = R.corpus_counts(spark.createDataFrame([(PROSE[0],)] * 200, "text string").coalesce(1))
    assert all((a == b).all() for a, b in zip(one, many)) and one[0].sum() > 50


def test_slices_do_not_change_the_result(rows, monkeypatch):
    texts = [t for _, t, _ in rows]
    col = pa.array(texts, pa.large_string())
    model = R.ResidueModel.fit(counts_of(texts))
    whole = {(i, k) for i, k, _, _ in R.residue_sentences(model, col)}
    longest = max(len(t.encode()) for t in texts)
    monkeypatch.setattr(R, "SLICE_BYTES", 2 * longest)
    assert {(i, k) for i, k, _, _ in R.residue_sentences(model, col)} == whole
    monkeypatch.setattr(R, "SLICE_BYTES", 400)  # texts fall into several parts
    assert {i for i, _, _, _ in R.residue_sentences(model, col)} == {i for i, _ in whole}


def test_parts_make_up_the_text(monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 50)
    for raw in (b"a" * 500, b"one two. " * 40, b"line\n" * 60, b"", b"x"):
        parts = list(R._parts(raw))
        assert b"".join(parts) == raw and all(len(p) <= 50 for p in parts)


def test_slot_spans():
    text = "a {{ gene }} b ${x_y} c [SAMPLE] d (mass) e 50 % of 30 % f mass[a] g <b>bold</b> «le nom»"
    buf = R._text([text])
    first, last, _, _ = R.slot_spans(buf)
    found = [buf[a:b].tobytes().decode() for a, b in zip(first, last)]
    assert found[:3] == ["{{ gene }}", "${x_y}", "[SAMPLE]"] and found[-1] == "\1le nom\2" and "(mass)" not in found


def test_windows_against_brute_force(rows):
    model = R.ResidueModel.fit(counts_of([t for _, t, _ in rows]))
    buf = R._text(["Please enable JavaScript. Peptides were digested.", "x", "404 Not Found"])
    begin, end, begins, ends = R._bounds(buf)
    grams, at = R.gram_buckets(buf), np.arange(len(buf), dtype=np.int32)
    (got,) = model.windows(buf, grams, (2,), at, begins, ends)
    for i in at:
        lo, hi = max(begins[i], i - model.half_window), min(ends[i], i + model.half_window + 1)
        values = [model.tables[j][2][grams[j][k]] / 1000 for j, (n, _) in enumerate(R.ORDERS) for k in range(lo, hi) if k + n <= ends[i]]
        assert abs(got[i] - (sum(values) / len(values) if values else -4.0)) < 1e-4


def test_held_out_examples(background):
    """Lines that a model has not seen are found; lines about residue mostly are not."""
    natural = counts_of(background)
    got = R.held_out(natural, folds=5)
    share = lambda kind: sum(n for (k, _), (n, _) in got.items() if k == kind) / sum(m for (k, _), (_, m) in got.items() if k == kind)
    assert share("slot") > 0.9 and share("filler") > 0.8 and share("error") > 0.85 and share("script") > 0.95 and share("contrast") < 0.4


UNSEEN = {
    "slot": ["Dear *|LNAME|*, thank you.", "Bonjour [% client_name %], merci.", "The value was {!Account.Name!} today.", "Hi {{recipient.first_name}}, it was sent."],
    "filler": ["Insert your biography here.", "Dies ist nur ein Platzhaltertext.", "Le contenu sera bientôt disponible.", "Aquí va la descripción del producto.", "At vero eos et accusam et justo duo dolores et ea rebum."],
    "error": ["Sorry, the page you are trying to reach does not exist.", "Die Seite konnte leider nicht gefunden werden.", "Une erreur inattendue est survenue.", "No se ha podido cargar la página.", "Proxy Error: the server could not handle the request."],
    "script": ["You must turn on JavaScript to see this map.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Pour voir cette page, activez les scripts.", "Habilite JavaScript en su navegador para ver la página."],
}


@pytest.mark.parametrize("kind", UNSEEN)
def test_unseen_wording(kind, background):
    natural = counts_of(background)
    hits = {i for i, _, _, _ in R.residue_sentences(R.ResidueModel.fit(natural), pa.array(UNSEEN[kind], pa.large_string()))}
    assert len(hits) >= 0.75 * len(UNSEEN[kind]), [x for i, x in enumerate(UNSEEN[kind]) if i not in hits]


@pytest.mark.parametrize(
    "kind,page",
    [
        ("error", lambda k: "404 Not Found"),
        ("error", lambda k: f"The page you requested could not be found.\nRequest {k * 7919}"),
        ("filler", lambda k: "Lorem ipsum dolor sit amet consectetur adipiscing elit."),
        ("slot", lambda k: f"Dear {{{{ customer }}}}, sample {k} was measured in the laboratory."),
        ("script", lambda k: f"{PROSE[k % 5]} Run {k}.\n\nPlease enable JavaScript to view this page."),
    ],
)
def test_residue_in_a_third_of_the_rows(spark, kind, page):
    prose = [(i, f"{PROSE[i % 5]} {i} " + " ".join(PROSE[:5])) for i in range(400)]
    df = spark.createDataFrame(prose + [(1000 + k, page(k)) for k in range(200)], "doc_id bigint, text string")
    found = {r.doc_id: r.kinds for r in R.residue_documents(df).collect()}
    assert sorted(found) == [1000 + k for k in range(200)] and all(kind in kinds for kinds in found.values())


def test_short_texts_that_are_nothing_else(background):
    short = {"TBD": "slot", " TODO\n": "slot", "???": "slot", "(to be filled in)": "slot", "to be completed": "slot", "xxxx xxxx": "filler", "asdf asdf": "filler", "foo bar": "filler", "Bla bla bla": "filler", "410 Gone": "error"}
    prose = ["abc", "Sample", "ALA", "bar", "Xylose", "To do", "TBDA", "yes", "x", "??", "MTBD TODO PEPTIDE"]
    texts = [*short, *prose]
    got = {texts[i]: k for i, k, _, _ in R.residue_sentences(R.ResidueModel.fit(counts_of(background)), pa.array(texts, pa.large_string()))}
    assert got == short
