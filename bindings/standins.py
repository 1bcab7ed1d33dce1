"""Small deterministic stand-ins for models, to test the data flow around them.

Each function returns a factory made inside it, so that it travels to the workers whole.
"""


def answers(failing: int = 0):
    """Digests of the prompts; with ``failing`` the prompts whose length it divides fail."""

    def make():
        import hashlib

        def answer(prompts):
            if failing and any(len(prompt) % failing == 0 for prompt in prompts):
                raise RuntimeError("no answer")
            return ["True: " + hashlib.md5(prompt.encode()).hexdigest() for prompt in prompts]

        return answer

    return make


def encoder():
    def make():
        import hashlib

        def encode(value):
            return [byte / 255.0 for byte in hashlib.md5(value.encode()).digest()[:8]]

        return lambda values: [encode(value) for value in values]

    return make


def word_overlap():
    def make():
        def score(reference, candidate):
            a, b = set(reference.split(" ")), set(candidate.split(" "))
            return 2.0 * len(a & b) / (len(a) + len(b))

        return lambda references, candidates: [score(r, c) for r, c in zip(references, candidates)]

    return make


def logits():
    def make():
        return lambda premises, hypotheses: [
            [len(p) / 100.0 % 3, len(h) / 100.0 % 3, 1.0] for p, h in zip(premises, hypotheses)
        ]

    return make


def reverser():
    def make():
        return lambda prompts: [prompt.split("\n\n", 1)[1][::-1] for prompt in prompts]

    return make
