import pytest
from chronofold.core.replay import outcome, replay
from chronofold.core.subdoc import Provision, edit, sentences
from chronofold.core.wording import body_of, canonical, similarity, squeezed_with_places, target_of

T = "Title\n(1) Alpha one. Alpha two.\n(2) Beta one.\n(3) Gamma a) first b) second"


def lines(*ledd):
    return "\n".join(["Title", *ledd])


A, B, C = "(1) Alpha one. Alpha two.", "(2) Beta one.", "(3) Gamma a) first b) second"


@pytest.mark.parametrize(
    "instruction, new, expected",
    [
        ("§ 4 tredje ledd oppheves", None, lines(A, B)),
        ("§ 4 første ledd oppheves", None, lines("(1) Beta one.", "(2) Gamma a) first b) second")),
        ("§ 4 siste ledd oppheves", None, lines(A, B)),
        ("§ 4 nytt andre ledd skal lyde:", "(2) Inserted.", lines(A, "(2) Inserted.", "(3) Beta one.", "(4) Gamma a) first b) second")),
        ("§ 4 nytt ledd skal lyde:", "(4) Added.", lines(A, B, C, "(4) Added.")),
        ("§ 4 nytt siste ledd skal lyde:", "Added bare.", lines(A, B, C, "Added bare.")),
        ("§ 4 første ledd andre punktum skal lyde:", "Alpha changed.", lines("(1) Alpha one. Alpha changed.", B, C)),
        ("§ 4 første ledd siste punktum skal lyde:", "(1) Alpha  changed.", lines("(1) Alpha one. Alpha changed.", B, C)),
        ("§ 4 første ledd nytt tredje punktum skal lyde:", "Alpha three.", lines(A + " Alpha three.", B, C)),
        ("§ 4 tredje ledd bokstav b skal lyde:", "b) changed", lines(A, B, "(3) Gamma a) first b) changed")),
        ("§ 4 tredje ledd ny bokstav c skal lyde:", "c) third", lines(A, B, C + " c) third")),
        ("§ 4 tredje ledd bokstav a oppheves", None, lines(A, B, "(3) Gamma a) second")),
        ("§ 4 nytt tredje og fjerde ledd skal lyde:", "(3) C. (4) D.", lines(A, B, "(3) C.", "(4) D.", "(5) Gamma a) first b) second")),
        ("§ 4 syvende ledd skal lyde:", "(2) Beta one revised.", lines(A, "(2) Beta one revised.", C)),
        ("§ 4 nytt andre ledd skal lyde:", "(2) Beta one.", T),
        ("§ 4 tredje ledd bokstav d skal lyde:", "d) z", None),
        ("§ 4 nr. 2 og nytt nr. 3 skal lyde:", "…", None),
        ("§ 4 første ledd andre punktum oppheves", None, None),
        ("§ 4 skal lyde:", "x", None),
        ("§ 4 niende ledd oppheves", None, None),
        ("§ 4 annet ledd", "x", None),
        ("§ 4 nytt tredje til femte ledd skal lyde:", "(3) C. (4) D.", None),
    ],
)
def test_golden(instruction, new, expected):
    assert edit(T, instruction, new) == expected


def test_unaddressable_and_nested():
    assert edit("Only a blob", "§ 4 andre ledd skal lyde:", "x") is None
    assert edit("T (1) One. (2) Two.", "andre ledd oppheves", None) == "T (1) One."
    nested = "Head\n(1) Lead 1. first a) x b) y 2. second"
    assert edit(nested, "§ 1 nr. 1 bokstav b skal lyde:", "b) z") == "Head\n(1) Lead 1. first a) x b) z 2. second"
    assert edit(nested, "§ 1 første ledd nr. 2 oppheves", None) == "Head\n(1) Lead 1. first a) x b) y"
    assert edit("Head\n(1) Lead 1. first 3. third", "§ 1 nr. 1 oppheves", None) is None


@pytest.mark.parametrize("text", [T, "T (1) One. (2) Two.", "\n(1) x", "Title\n"])
def test_reading_and_writing_is_the_identity(text):
    assert str(Provision.read(text)) == text


def test_sentences():
    assert sentences("One. Two. three. Four") == ["One.", "Two. three.", "Four"]
    assert sentences("Etter lov nr. 4 gjelder dette.") == ["Etter lov nr.", "4 gjelder dette."]


BASE = {"§1": "old one", "§2": "old two"}


@pytest.mark.parametrize(
    "para, change, instruction, new, text, why",
    [
        ("§1", "change", "", "§ 1. New one.", "New one.", None),
        ("§1", "unknown", "", "§ 1. New one.", "New one.", None),
        ("§1", "change", "§ 1 skal lyde:", "bare body", "old one", "change"),
        ("§9a", "add", "ny § 9a skal lyde:", "bare body", "bare body", None),
        ("§kapittel4", "add", "", "bare body", None, "add"),
        ("§2", "repeal", "§ 2 oppheves", None, None, None),
        ("§2", "repeal", "§ 2 andre ledd oppheves", None, "old two", "repeal-subunit"),
        ("§1", "change", "§ 1 overskriften skal lyde:", "X", "old one", None),
        ("§1", "renumber", "", None, "old one", "renumber"),
        (None, None, None, None, None, ""),
    ],
)
def test_transitions(para, change, instruction, new, text, why):
    assert outcome(BASE.get(para), para, change, instruction, new) == (text, why)


def test_whole_overwrites_are_idempotent():
    op = ("2001-01-01", "change", "§ 1 skal lyde:", "§ 1. New one.")
    once, twice = replay("old", "§1", [op]), replay("old", "§1", [op, op])
    assert once.text == twice.text and once.versions == twice.versions


def test_wording():
    assert canonical("§ 5 Første ledd. Endret ved lov 1") == "5 første ledd"
    assert canonical("som endret ved forordning") == "som endret ved forordning"
    assert canonical("Tekst (ikr. 1 juli 2011 iflg. res. 3) videre") == "tekst videre"
    assert similarity("", "") == 1.0 and similarity("x", "") == 0.0
    assert similarity("tide", "diet") == 0.25 and similarity("diet", "tide") == 0.5
    assert body_of("§ 5-8 a. Tekst  her") == "Tekst her" and body_of("§ 27 første") == "første"
    assert squeezed_with_places("  a\n b ") == ("a b", [2, 3, 5])
    assert target_of(["x y", "x y"], "x y").index == 1
