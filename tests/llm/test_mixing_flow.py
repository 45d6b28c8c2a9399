"""The network of op3_mixing carries patterns of one source, too."""

from trackloom.llm import mixing


def test_single_sources_go_through_the_network(monkeypatch):
    pushed, push = [], mixing.heapq.heappush
    monkeypatch.setattr(mixing.heapq, "heappush", lambda heap, x: (pushed.append(x), push(heap, x))[1])
    flow = mixing.min_cost_flow([10, 7, 0], [[0], [1], [2]], [25, 3, 4], 3)
    assert pushed and flow == [{0: 25}, {1: 3}, {}]
