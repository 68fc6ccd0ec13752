from rollbook.llm import workers


def test_a_worker_keeps_one_thing():
    made = []

    def make(name):
        return lambda: made.append(name) or [name]

    first = workers.kept("a", make("a"))
    assert workers.kept("a", make("a")) is first and made == ["a"]
    assert workers.kept("b", make("b")) == ["b"] and workers.kept("a", make("a")) is not first
    workers.free()
    workers.free()
    assert workers.kept("a", make("a")) == ["a"] and made == ["a", "b", "a", "a"]
