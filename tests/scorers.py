"""Scorers for the command line's tests: named as module:function."""


def by_length():
    def score(pdf):
        return [[float(len(x) % 3 == i) for i in range(3)] for x in pdf["input_ids"]]
    return score


def by_fold(fold):
    def score(pdf):
        return [[float((len(x) + fold) % 3 == i) for i in range(3)] for x in pdf["input_ids"]]
    return score
