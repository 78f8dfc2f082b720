"""A fit function for ``walk_forward_fit``, as a caller would write one."""

from __future__ import annotations


def line_and_mean():
    def fit_predict(x_train, y_train, x_test, hp, seed):
        import numpy as np
        if "lookback" in hp:
            return np.full(len(x_test), y_train[-hp["lookback"]:].mean()), None
        x = x_train[:, 0]
        if x.min() == x.max():
            return np.full(len(x_test), y_train.mean()), None
        slope, base = np.polyfit(x, y_train, 1)
        return base + slope * x_test[:, 0], None
    return fit_predict


def mean_of_layers():
    """Mean of as many last labels as the net would have layers: a stand-in for a learner of the grid."""
    def fit_predict(x_train, y_train, x_test, hp, seed):
        import numpy as np
        k = hp.get("num_layers", hp.get("blocks"))
        if x_train.shape[1] != x_test.shape[1] or not np.isfinite(x_train).all():
            raise ValueError("features")
        return np.full(len(x_test), y_train[-k:].mean()), None
    return fit_predict


#: What each activation adds to a forecast of ``shifted_mean``.
ACTIVATION_SHIFT = {"relu": 0.0, "tanh": 0.0001, "swish": 0.0002}


def shift(hp: dict) -> float:
    """Standard deviations that a forecast is moved by, another number for each config of a net."""
    return (hp.get("hidden_units", hp.get("channels")) / 10000 + hp["epochs"] / 100000 + float(hp["learning_rate"]) / 10
            + ACTIVATION_SHIFT[hp["activation"]])


def shifted_mean():
    """The same, moved by what the other hyper-parameters say, so that no two configs of a net are equal."""
    def fit_predict(x_train, y_train, x_test, hp, seed):
        import numpy as np
        k = hp.get("num_layers", hp.get("blocks"))
        return np.full(len(x_test), y_train[-k:].sum() / k + shift(hp)), None
    return fit_predict
