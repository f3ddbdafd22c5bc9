"""Classifiers by case-insensitive name: fit(df, sparse, width), predict(df), params()."""

from .linear_svm import HingeSGD, SquaredHingeSVM
from .mlp import NeuralNetwork, Settings
from .neighbours import NearestNeighbours


def make_model(name, n_classes, seed=42, *, knn_neighbors=5, knn_metric="auto", svm_c=1.0, svm_max_iter=5000,
               svm_scale_dense=False, svm_alpha=1e-4, svm_learning_rate="optimal", svm_eta0=0.01, dnn_hidden_dim=128, dnn_epochs=20, dnn_batch_size=256,
               dnn_lr=1e-3, dnn_dropout=0.2, dnn_early_stopping=True, dnn_validation_fraction=0.1, dnn_patience=3,
               dnn_min_delta=0.0, dnn_weight_decay=0.0, allow_dnn_sparse_to_dense=False, **_):
    """A classifier with the sweep's options; unused options are for other stages."""

    def network():
        return NeuralNetwork(
            n_classes,
            Settings(
                dnn_hidden_dim, dnn_epochs, dnn_batch_size, dnn_lr, dnn_dropout, seed, dnn_early_stopping,
                dnn_validation_fraction, dnn_patience, dnn_min_delta, dnn_weight_decay, allow_dnn_sparse_to_dense,
            ),
        )

    makers = {
        "knn": lambda: NearestNeighbours(knn_neighbors, knn_metric),
        "svm": lambda: SquaredHingeSVM(svm_c, svm_max_iter, seed, svm_scale_dense),
        "svm_sgd": lambda: HingeSGD(
            svm_alpha, svm_max_iter, seed=seed, scale_dense=svm_scale_dense, learning_rate=svm_learning_rate, eta0=svm_eta0
        ),
        "dnn": network,
    }
    if name.lower() not in makers:
        raise ValueError(f"Unknown model: {name}")
    return makers[name.lower()]()
