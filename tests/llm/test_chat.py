import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import chat
from routeloom.llm.common import ship

MARKS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE]", "[TEXT]", "\\", "\\\\", "[", "<", "a", "\n", " "])
TEXT = st.lists(st.one_of(MARKS, st.text(max_size=3)), max_size=6).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]"]), TEXT), max_size=5)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_read_back(turns):
    r = chat.render(turns)
    assert r.rewritten is None and chat.parse(r.text) == turns
    assert [chat.unescape(r.text[a:b]) for a, b in r.inner] == [t for _, t in turns]
    assert [r.text[a:b] for a, b in r.spans] == [chat.template([t]) for t in turns]


def test_rewriting_template_is_found():
    def only_last(turns):
        return "".join(f"<{r}>" + (t if i >= len(turns) - 2 else "") for i, (r, t) in enumerate(turns))

    assert chat.render([("user", "x"), ("assistant", "y"), ("user", "z")], only_last).rewritten == 2


def test_frame(spark):
    ship(spark)
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "assistant", probe), (1, 2, "assistant", probe), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    turns = [("user", "a"), ("assistant", "b"), ("assistant", probe), ("assistant", probe)]
    one = got[1]
    assert one.n_turns == 4 and one.loss_chars == 1 + 2 * len(probe) and one.formatted_chars == len(one.formatted)
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert one.loss_sha256 == hashlib.sha256(("b" + 2 * probe).encode()).hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.formatted(df.limit(0)).count() == 0
