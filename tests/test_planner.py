import pytest

from quiverlake.errors import InvalidArgument
from quiverlake.plans.planner import SplitMix64, choose, sampled_nodes


@pytest.mark.parametrize(
    "nodes,dim,share,ef,k,adaptive,strategy",
    [
        (2000, 16, 0.3, None, 10, 214, "filtered_exact"),
        (2000, 16, 0.0, None, 10, 2000, "filtered_exact"),
        (5000, 4, 1 / 3, None, 10, 192, "index"),
        (2500, 2, 0.5, 16, 5, 32, "index"),
        (500, 64, 1.0, None, 10, 64, "filtered_exact"),
        (500, 64, 0.1, None, 10, 500, "filtered_exact"),
        (2000, 64, 1.0, None, 10, 64, "index"),
        (2000, 64, 0.5, None, 10, 128, "index"),
        (2000, 64, 0.1, None, 10, 640, "filtered_exact"),
        (2000, 8, None, 100, 10, 100, "index"),
    ],
)
def test_choice(nodes, dim, share, ef, k, adaptive, strategy):
    plan = choose(nodes, nodes, dim, k, share, ef)
    assert (plan.adaptive_ef, plan.strategy) == (adaptive, strategy)


def test_exact_and_bad_arguments():
    assert choose(10, 10, 2, 3, exact=True).strategy == "exact"
    for bad in ({"k": 0}, {"k": 1, "ef": 0}):
        with pytest.raises(InvalidArgument):
            choose(10, 10, 2, **bad)


def test_generator_is_the_published_one():
    rng = SplitMix64(1234567)
    assert [rng.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_sample_keeps_repeats():
    assert sampled_nodes(512) is None
    assert len(sampled_nodes(600)) == 512 and max(sampled_nodes(600)) < 600
