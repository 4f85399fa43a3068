"""What the driver holds while the pipeline's models are fitted stays small beside the samples."""

import random
import tracemalloc

import pytest

from loomline.llm import quality, toxicity


def sample(n=1500, words=300):
    rng = random.Random(16)
    return [" ".join(f"word{rng.randrange(3000)}" for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("learn", [lambda t: toxicity.learn_lexicon(t, [k % 9 == 0 for k in range(len(t))]), quality.learn_vectors], ids=["toxicity", "quality"])
def test_a_sample_is_not_held_as_words(learn):
    """Fifteen times the words in as many texts: what is held besides the texts hardly grows."""
    texts, most = sample(), []
    for some in (texts[:100], texts):
        tracemalloc.start()
        learn(some)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] - most[0] < 2 * sum(map(len, texts)), most
