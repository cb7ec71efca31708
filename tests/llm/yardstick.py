"""The packing that the rounds are measured by: best-fit decreasing, one length after another."""

from bisect import bisect_left, insort


def plan_best_fit(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of each length go.

    A sequential loop on the driver, from the longest run of documents to the shortest. Gaps are runs of sequences
    that are filled alike: gaps[g] holds (first sequence, number) and `order` the sizes in use.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect_left(order, length)
            if at < len(order):  # the successor: the smallest gap that takes this length
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                take = min(n, end - rank)
                plan.append((length, rank, rank + take, first, capacity - gap))
                put(gap, first + take, n - take)
                put(gap - length, first, take)
                rank += take
            else:  # new sequences, as many of this length in each as fit
                each = capacity // length
                n = (end - rank) // each or 1
                for slot in range(min(each, end - rank)):
                    plan.append((length, rank, rank + n, opened, slot * length))
                    rank += n
                    used = (slot + 1) * length
                put(capacity - used, opened, n)
                opened += n
    return plan
