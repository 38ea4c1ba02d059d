import pytest

from cubeloom import Definition, Rollup, dimension, fact, measure, ratio, tenant, time
from cubeloom.errors import DefinitionError
from cubeloom.model.path import Path, alias_of

from .shop import ShopMetrics


def test_paths():
    assert Path.parse("a") == Path((), "a") and Path.parse("a").local
    assert Path.parse({"order": {"customer": "c"}}) == Path(("order", "customer"), "c")
    assert Path.parse_association({"order": "store"}) == Path(("order", "store"), None)
    assert Path.parse_association("order").hops == ("order",)
    assert str(Path.parse({"a": {"b": "c"}})) == "a.b.c"
    assert len({Path.parse("a"), Path.parse("a")}) == 1
    assert alias_of(()) == "f" and alias_of(("a", "b")) == "g_a_b"


@pytest.mark.parametrize("via", [{"a": "x", "b": "y"}, 7, "", None, [], {"a": {"b": {"c": {"d": "x"}}}}, {1: "x"}])
def test_bad_paths(via):
    with pytest.raises(DefinitionError):
        Path.parse(via)


def test_three_hops_are_followed():
    assert len(Path.parse({"a": {"b": {"c": "x"}}}).hops) == 3


def test_key_order_is_tenant_time_then_declared():
    class Mixed(Rollup):
        z = dimension("z")
        on = time("at", bucket="day")
        lines = fact("t")
        a = dimension("a")
        who = tenant("who")
        n = measure(count=True)

    d = Mixed.definition()
    assert d.keys == ("who", "on", "z", "a") and d.columns == ("who", "on", "z", "a", "n") and d.temporal
    assert d.table_name("cube_") == "cube_mixeds"
    assert Mixed.definition() is d


def test_definitions_are_isolated_and_names_plural():
    assert ShopMetrics.definition().table_name("x_") == "x_shop_metricses"
    one = Definition.of("DailyEntry", {"f": fact("t"), "who": tenant("w"), "n": measure(count=True)})
    assert one.table_name("cube_") == "cube_daily_entries"


def test_measures():
    m = measure(sum="x", type="decimal")
    assert m.data_type.simpleString() == "decimal(38,6)" and m.coarser == "sum" and m.reversible
    assert measure(count=True).coarser == "sum" and measure(count="x").expression == "x"
    assert measure(max="x", type="int").coarser == "max" and not measure(max="x", type="int").reversible
    assert [p.hops for p in measure(count=True, through=["a", {"b": "c"}]).through] == [("a",), ("b", "c")]
    assert measure(sum="x", type="decimal(10,2)").data_type.scale == 2


@pytest.mark.parametrize(
    "make",
    [
        lambda: measure(),
        lambda: measure(count=True, sum="x", type="bigint"),
        lambda: measure(sum=True, type="bigint"),
        lambda: measure(sum="", type="bigint"),
        lambda: measure(sum="x"),
        lambda: measure(sum="x", type="blob"),
        lambda: ratio("a", "a"),
        lambda: time("x"),
        lambda: time("x", bucket="hour"),
        lambda: dimension("x", bucket="day"),
        lambda: fact(""),
        lambda: fact("t", where=["x"]),
        lambda: fact("t", where={"a": [1]}),
        lambda: fact("t", where={"a": {"b": {"c": 1}}}),
    ],
)
def test_refused_declarations(make):
    with pytest.raises(DefinitionError):
        make()


BASE = {"f": fact("t"), "who": tenant("w"), "n": measure(count=True)}


@pytest.mark.parametrize(
    "declared",
    [
        {k: v for k, v in BASE.items() if k != "f"},
        {k: v for k, v in BASE.items() if k != "who"},
        {k: v for k, v in BASE.items() if k != "n"},
        BASE | {"g": fact("u")},
        BASE | {"two": tenant("v")},
        BASE | {"a": time("x", bucket="day"), "b": time("y", bucket="day")},
        BASE | {"r": ratio("n", "missing")},
        BASE | {"r": ratio("who", "n")},
    ],
)
def test_incomplete_definitions(declared):
    with pytest.raises(DefinitionError):
        Definition.of("Thing", declared)
    Definition.of("Thing", BASE)


def test_a_name_is_declared_once():
    with pytest.raises(DefinitionError):

        class Twice(Rollup):
            lines = fact("t")
            who = tenant("w")
            n = measure(count=True)
            n = measure(sum="x", type="bigint")  # noqa: F811


def test_hop_chains_are_shared():
    d = Definition.of("T", BASE | {"a": dimension({"o": "x"}), "b": dimension({"o": {"c": "y"}}), "m": measure(count=True, through={"o": "c"})})
    assert d.hop_chains == (("o",), ("o", "c"))
