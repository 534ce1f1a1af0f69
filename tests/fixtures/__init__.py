"""A small paper in pages and blocks, of invented text."""

PAGES = [
    (1, ["A Study of Rank Limited Updates for Speech", "Abstract", "We propose a novel update rule. It reduces the number of trained weights by a factor of ten thousand.", "1 Introduction", "Large models are costly to adapt.\nThe problem is memory, and the goal is to cut it."]),
    (2, ["2. Proposed Method", "2.1 Update Rule", "EQUATION: h = W0 x + BA x", "where BA denotes the update of rank r. The objective is the usual loss.", "Model weights are frozen during training."]),
    (3, ["Results", "Table 1: WER on the test set", "Model | WER\nBaseline | 5.1%\nOurs | 4.2%\nOurs | 4.2%\nx2 | 9\nLarge Conformer | 3.9%", "TABLE:\nBatch size | 32\nDropout | 0.1", "The proposed model improves accuracy. On the test set it achieves 4.2% WER."]),
    (4, ["References", "Someone et al. A paper. Journal of Papers."]),
]
