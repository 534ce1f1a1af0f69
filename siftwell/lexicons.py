"""Word lists, tables and thresholds. Every operator takes its lists as parameters; these are the defaults."""

# Results depend on them exactly.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "which", "with"]

ROLES = ["problem", "idea", "method", "algorithm", "equation", "formula", "theory", "evaluation", "implementation", "discussion", "other"]
ROLE_KEYWORDS = {
    "problem": ["problem", "challenge", "limitation", "goal", "objective", "motivation"],
    "idea": ["we propose", "key idea", "insight", "novel", "framework", "approach"],
    "method": ["method", "pipeline", "procedure", "stage", "module", "component"],
    "algorithm": ["algorithm", "step", "pseudocode", "complexity", "runtime", "procedure"],
    "equation": ["equation", "=", "[equation]"],
    "formula": ["formula", "objective", "loss is defined", "mathematically"],
    "theory": ["theorem", "lemma", "proof", "corollary", "bound", "proposition"],
    "evaluation": ["experiment", "results", "benchmark", "comparison", "ablation", "accuracy", "latency"],
    "implementation": ["implementation", "system", "deployment", "engineering", "prototype", "infrastructure"],
    "discussion": ["discussion", "limitation", "future work", "threats to validity", "conclusion"],
}
SECTION_ROLE_HINTS = {
    "abstract": "idea", "introduction": "problem", "background": "problem", "related_work": "other", "method": "method", "methodology": "method", "approach": "method", "algorithm": "algorithm", "theory": "theory",
    "proof": "theory", "implementation": "implementation", "system": "implementation", "experiment": "evaluation", "results": "evaluation", "evaluation": "evaluation", "discussion": "discussion", "conclusion": "discussion",
}
SECTION_ROLE_PRIORS = {
    "abstract": ["idea", "problem"], "introduction": ["problem", "idea"], "method": ["method", "algorithm"], "methodology": ["method", "algorithm"], "approach": ["method", "algorithm"],
    "results": ["evaluation"], "evaluation": ["evaluation"], "experiment": ["evaluation"], "conclusion": ["discussion"],
}
INTENT_KEYWORDS = {
    "definition": ["what is", "define", "definition", "overview", "motivation", "problem"],
    "method": ["method", "approach", "algorithm", "pipeline", "implementation", "how"],
    "evaluation": ["evaluate", "results", "benchmark", "metric", "performance", "ablation"],
    "theory": ["theorem", "proof", "lemma", "bound", "complexity", "formal"],
    "comparison": ["compare", "difference", "baseline", "versus", "vs", "better than"],
}
INTENT_ROLE_MATCHES = {"definition": ["problem", "idea"], "method": ["method", "algorithm"], "evaluation": ["evaluation"], "theory": ["theory"], "comparison": ["evaluation"]}
INTENT_ROLE_NEUTRALS = {"definition": ["discussion"], "method": ["implementation", "idea"], "evaluation": ["discussion", "method"], "theory": ["algorithm", "idea"], "comparison": ["discussion", "method"]}
INTENT_ROLE_WEIGHTS = {
    "definition": {"problem": 1.0, "idea": 0.9, "discussion": 0.6, "other": 0.4},
    "method": {"method": 1.0, "algorithm": 0.95, "equation": 0.85, "formula": 0.85, "implementation": 0.75, "idea": 0.5},
    "evaluation": {"evaluation": 1.0, "discussion": 0.7, "method": 0.5},
    "theory": {"theory": 1.0, "equation": 0.8, "formula": 0.8, "algorithm": 0.65, "idea": 0.5},
    "comparison": {"evaluation": 1.0, "discussion": 0.8, "method": 0.45},
}
SECTION_PRIORS = {
    "definition": {"abstract": 1.0, "introduction": 0.9, "discussion": 0.5},
    "method": {"method": 1.0, "methodology": 1.0, "algorithm": 0.95, "implementation": 0.8},
    "evaluation": {"results": 1.0, "evaluation": 1.0, "experiment": 0.9, "discussion": 0.6},
    "theory": {"theory": 1.0, "proof": 1.0, "method": 0.6},
    "comparison": {"results": 1.0, "evaluation": 0.95, "discussion": 0.8},
}
SECTION_WEIGHTS = {"method": 1.35, "experiments": 1.3, "results": 1.2, "abstract": 1.1, "introduction": 1.0, "front_matter": 0.95, "discussion": 0.95, "conclusion": 0.9, "related_work": 0.7, "references": 0.05}
SECTION_ALIASES = {
    "abstract": "abstract", "introduction": "introduction", "background": "related_work", "related work": "related_work", "related works": "related_work", "prior work": "related_work", "method": "method", "methods": "method",
    "methodology": "method", "approach": "method", "model": "method", "proposed method": "method", "architecture": "method", "experiments": "experiments", "experimental setup": "experiments", "implementation details": "experiments",
    "training setup": "experiments", "evaluation": "results", "results": "results", "analysis": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "references": "references",
}
METRICS = ["wer", "cer", "bleu", "rouge", "f1", "accuracy", "error rate", "latency", "perplexity", "precision", "recall", "map"]
PSEUDOCODE = ["algorithm", "procedure", "for each", "while ", "if ", "return "]
RESULT_CUES = ["benchmark", "experiment", "results", "table", "figure", "comparison", "improve", "%"]
CITATIONS = [r"\[[0-9,\s]+\]", r"et al\.", r"arxiv preprint", r"proceedings of", r"ieee", r"journal of"]
CONTRADICTIONS = ["however", "but", "although", "worse", "fails", "failure", "limitation", "in contrast", "whereas"]
FORMULA_QUERY = ["formula", "formulas", "equation", "equations", "mathematical expression", "math expression", "mathematical formulation", "objective function", "notation", "derivation"]
FORMULA_EXPANSION = ["equation", "formula", "mathematical formulation", "objective", "notation"]
TABLE_QUERY = ["table", "tables", "results table", "result table", "ablation table", "benchmark table"]
TABLE_EXPANSION = ["table", "caption", "results", "metrics"]
REFERENCE_QUERY = ["reference", "references", "citation", "cite", "bibliography", "prior work"]
LITERAL_QUERY = ["list", "show", "provide", "give me", "which are", "what are"]
FORMULA_SECTIONS = ["method", "methodology", "theory", "introduction", "preliminaries", "notation", "approach"]
FORMULA_SUBSECTIONS = ["equation", "formula", "objective", "loss", "notation", "parameterization", "preliminar", "derivation"]
FOLLOW_UP_STARTERS = ["it", "they", "them", "that", "this", "those", "these", "he", "she", "there"]
FOLLOW_UP_PATTERNS = [
    r"^(?:what|which|where|why|how)\s+(?:is|are|does|did|do|was|were)\s+(?:it|they|that|this|those|these)\b",
    r"^(?:what|which)\s+(?:equation|formula|expression)\b",
    r"^(?:what's|whats)\s+(?:the\s+)?(?:equation|formula|mathematical expression)\b",
    r"^where does the paper say that\b",
    r"^why did you say\b",
    r"^how does it work\b",
    r"^what about\b",
]
REFERENCED_ANSWER = ["that", "there", "before", "say that", "why did you say", "where does the paper say"]
EVIDENCE = {
    "methodology": {"keywords": ["method", "approach", "architecture", "algorithm", "module", "pipeline"], "roles": ["method", "algorithm", "implementation", "theory"], "sections": ["method", "methodology", "algorithm", "implementation"]},
    "dataset": {"keywords": ["dataset", "corpus", "benchmark", "data", "train set", "test set"], "roles": ["evaluation", "implementation", "idea"], "sections": ["experiments", "results", "method", "abstract"]},
    "evaluation": {"keywords": ["result", "evaluation", "metric", "benchmark", "ablation", "performance"], "roles": ["evaluation", "discussion"], "sections": ["results", "evaluation", "experiments", "discussion"]},
    "reproducibility": {"keywords": ["code", "repository", "reproduce", "training", "hyperparameter", "implementation"], "roles": ["implementation", "discussion", "method"], "sections": ["method", "experiments", "discussion", "conclusion"]},
    "comparison": {"keywords": ["baseline", "compare", "versus", "vs", "outperform", "better than"], "roles": ["evaluation", "discussion"], "sections": ["results", "evaluation", "discussion", "related_work"]},
    "limitations": {"keywords": ["limitation", "future work", "challenge", "failure", "tradeoff"], "roles": ["discussion", "evaluation"], "sections": ["discussion", "conclusion", "results"]},
}
DOMAINS = {
    "ml": ["neural", "training", "dataset", "loss", "optimizer", "inference", "accuracy", "transformer", "embedding"],
    "theory": ["theorem", "lemma", "proof", "corollary", "bound", "complexity", "approximation"],
    "systems": ["throughput", "latency", "distributed", "deployment", "cluster", "fault tolerance", "scalability", "runtime"],
    "security": ["attack", "threat", "adversary", "vulnerability", "encryption", "malware", "intrusion", "privacy"],
    "networks": ["network", "routing", "packet", "bandwidth", "protocol", "tcp", "wireless", "congestion"],
}
DOMAIN_ROLE_PRIORS = {"ml": ("evaluation", 0.2), "theory": ("theory", 0.25), "systems": ("implementation", 0.18), "security": ("discussion", 0.12)}
TABLE_TYPES = {
    "hyperparameter": ["learning rate", "batch size", "max seq", "dropout", "optimizer"],
    "ablation": ["ablation", "remove", "without", "effect of"],
    "results": ["accuracy", "wer", "cer", "bleu", "rouge", "benchmark", "results"],
    "architecture": ["layer", "component", "module", "parameter", "architecture"],
}
BANNED_STARTS = ["figure", "fig.", "table", "eq.", "equation:", "index terms:"]
BANNED_FRAGMENTS = [r"\bms rate\b", r"\bx\s*n\s*\+", r"\b1/2\s*x\b", r"\bsubsampling\b"]
VERBS = [
    "is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "can", "could", "may", "might", "will", "would", "should",
    "propose", "proposes", "proposed", "introduce", "introduces", "introduced", "show", "shows", "showed", "demonstrate", "demonstrates", "demonstrated",
    "contain", "contains", "contained", "consist", "consists", "consisted", "include", "includes", "included", "improve", "improves", "improved",
    "achieve", "achieves", "achieved", "evaluate", "evaluates", "evaluated", "use", "uses", "used", "perform", "performs", "performed", "yield", "yields", "yielded",
    "reduce", "reduces", "reduced", "increase", "increases", "increased", "outperform", "outperforms", "outperformed", "appear", "appears", "appeared",
    "allow", "allows", "allowed", "provide", "provides", "provided",
]
CONTINUATIONS = ["where ", "where,", "under ", "for ", "on ", "when ", "while ", "with ", "which ", "this ", "these ", "it ", "they ", "we ", "our ", "such "]
EXPLANATIONS = ["denotes", "represents", "is defined as", "is computed as", "is the", "refer to", "corresponds to", "objective", "loss"]
CLAIM_METRICS = ["wer", "cer", "bleu", "rouge", "f1", "accuracy", "error rate", "latency"]
TABLE_METRICS = ["wer", "cer", "bleu", "rouge", "f1", "accuracy", "latency", "perplexity", "precision", "recall"]
TABLE_DATASETS = ["mnli", "sst-2", "mrpc", "cola", "qnli", "qqp", "rte", "sts-b", "librispeech", "wikisql", "webnlg", "dart", "samsum"]
EQUATION_MARKS = ["=", "∑", "Σ", "argmax", "argmin", "log", "exp", "lambda", "β", "α"]
CLAUSES = [" and ", " or ", " while ", " versus ", " vs "]
COMPARISONS = ["compare", "difference", "baseline", "tradeoff"]
CRITIQUES = ["why", "weakness", "limitation", "critique", "reproduc"]
PUBLIC_DATASETS = ["librispeech", "imagenet", "coco", "cifar", "mnist", "wmt", "squad"]
REPO_SOURCE_BONUS = {"paper_link": 0.35, "paperswithcode": 0.25, "github_search": 0.15}
MODEL_FAMILIES = {"conformer": ["conformer"], "transformer": ["transformer", "attention"], "recurrent": ["lstm", "gru", "rnn"], "cnn": ["cnn", "convolution", "resnet"]}
TASK_TYPES = {
    "speech_asr": ["librispeech", "common voice", "speech", "asr", "transcript", "wer"],
    "image_classification": ["imagenet", "cifar", "mnist", "classification", "accuracy", "top-1"],
    "sequence_to_sequence": ["translation", "summarization", "seq2seq", "bleu"],
}
LOSS_ALIASES = {
    "cross_entropy": ["cross entropy", "cross-entropy", "ce", "nll"],
    "bce_with_logits": ["bce", "bcewithlogits", "binary cross entropy", "binary_cross_entropy"],
    "mse": ["mse", "mean squared error", "l2 loss"],
    "ctc": ["ctc", "ctc loss"],
}
CANONICAL_ARCHITECTURES = {"transformer model": "Transformer", "transformer": "Transformer", "conformer": "Conformer", "rnn": "RNN", "recurrent neural network": "RNN", "cnn": "CNN", "convolutional neural network": "CNN"}
ARCHITECTURE_ALIASES = {
    "Mask-Conformer": [r"\bmask[\s-]?conformer\b"], "Transformer": [r"\btransformer\b", r"\btransducer\b"], "Conformer": [r"\bconformer\b"], "CNN": [r"\bcnn\b", r"\bconvolutional neural network\b"],
    "RNN": [r"\brnn\b", r"\brecurrent neural network\b"], "LSTM": [r"\blstm\b"], "GRU": [r"\bgru\b"], "GAN": [r"\bgan\b", r"\bgenerative adversarial network\b"], "Diffusion": [r"\bdiffusion\b"], "Autoencoder": [r"\bautoencoder\b"],
    "Graph Neural Network": [r"\bgraph neural network\b", r"\bgnn\b"],
}
PROPOSAL_PATTERNS = [r"\bwe propose\b", r"\bwe present(?:ed)?\b", r"\bwe introduce(?:d)?\b", r"\bour proposed\b", r"\bour model\b", r"\bnovel\b", r"\bnamed\b", r"\bcalled\b"]
BASELINE_PATTERNS = [r"\bbaseline\b", r"\bprior work\b", r"\bprevious best\b", r"\bprevious work\b", r"\bcompared with\b", r"\bcompared to\b", r"\boutperforming\b", r"\brelative to\b", r"\bsimilar approaches\b", r"\bcontemporary work\b"]
SPECIFICITY = {"Mask-Conformer": 0.45, "Conformer": 0.3, "Transformer": 0.05}
SUPPRESSED_BY = {"Mask-Conformer": ["Conformer", "Transformer"], "Conformer": ["Transformer"]}
ML_NAMES = {
    "datasets": ["ImageNet", "COCO", "CIFAR-10", "CIFAR-100", "MNIST", "LibriSpeech", "SQuAD", "WMT"],
    "losses": ["CrossEntropy", "BCEWithLogits", "MSE", "CTC", "RNNT", "Hinge"],
    "optimizers": ["Adam", "AdamW", "SGD", "RMSprop", "Adagrad"],
    "metrics": ["accuracy", "f1", "precision", "recall", "bleu", "rouge", "wer", "latency"],
}
SNIPPETS = {
    "theorems": (r"(theorem\s+\d+[^.]*\.|theorem[^.]*\.)", 8), "proofs": (r"(proof[^.]*\.)", 8), "complexity_claims": (r"(O\([^)]*\)[^.]*\.)", 8),
    "system_components": (r"(component[^.]*\.|module[^.]*\.|pipeline[^.]*\.|architecture[^.]*\.)", 10), "performance_claims": (r"((latency|throughput|speedup|overhead|efficiency)[^.]*\.)", 10),
    "benchmarks": (r"(benchmark[^.]*\.|evaluation[^.]*\.|workload[^.]*\.)", 10),
}
CONTRIBUTIONS = (r"(we propose[^.]*\.|our method[^.]*\.|we introduce[^.]*\.)", 5)
DOMAIN_VIEWS = {"ml": "ml", "theory": "theory", "systems": "systems", "security": "systems", "networks": "systems"}
SYNTHESIS_SECTIONS = ["key_ideas", "methods", "results", "discussion"]
CODE_INTENT = ["code", "implement", "write", "example", "snippet", "how to build", "python"]
SUBTASK_TITLES = {
    "methodology": "Methodology Extraction", "dataset": "Dataset Inspection", "evaluation": "Evaluation Review", "reproducibility": "Reproducibility Check", "comparison": "Baseline Comparison", "limitations": "Limitations Review",
}
VOCABULARY = r"(?i)(\d+)\s*(?:wpm|word pieces|wordpiece|vocabulary)"
NUMBERS = r"\b\d+(\.\d+)?%?\b"
# Signals of reproducibility by group: the fields they are looked for in, and the words (none: anything at all).
REPRODUCIBILITY = {
    "hyperparameters": {
        "learning_rate": (["training_details"], ["learning rate", "lr ", "warm-up", "peak learning rate"]),
        "batch_size": (["training_details"], ["batch size", "batchsize"]),
        "optimizer": (["optimizer"], []),
        "epochs": (["training_details"], ["epoch", "epochs", "steps"]),
        "scheduler": (["training_details"], ["schedule", "scheduler", "warm-up", "decay"]),
    },
    "training": {
        "optimizer_detected": (["optimizer"], []),
        "loss_detected": (["loss"], []),
        "training_pipeline_described": (["training_details"], ["train", "optimizer", "regularization", "schedule"]),
        "data_splits_mentioned": (["dataset", "training_details"], ["train", "dev", "validation", "test", "split"]),
        "augmentation_described": (["training_details"], ["augment", "specaugment", "crop", "mask", "flip"]),
    },
    "evaluation": {
        "metrics_present": (["evaluation_metrics"], []),
        "test_dataset_specified": (["dataset", "contributions"], ["test", "benchmark", "librispeech", "imagenet", "coco", "wmt", "squad"]),
        "comparison_baselines_present": (["architectures", "contributions"], ["baseline", "compare", "outperform", "transformer", "contextnet", "cnn"]),
        "benchmark_dataset_mentioned": (["dataset"], PUBLIC_DATASETS),
    },
    "methodology": {
        "method_present": (["training_details"], ["method", "algorithm", "pipeline", "system"]),
        "implementation_clues": (["training_details"], ["implementation", "module", "component", "setup"]),
        "limitations_or_discussion": (["training_details"], ["limitation", "threat", "future work"]),
    },
    "results": {
        "metrics_present": (["evaluation_metrics"], []),
        "comparisons_present": (["results"], ["baseline", "compare", "improve", "outperform"]),
        "benchmark_or_workload_present": (["results"], ["benchmark", "dataset", "workload", "testbed"]),
    },
}
ASSIGNMENT = r"[A-Za-zΔ∆WBAqkvroαβσ_′'0-9][^.;\n]{0,40}=\s*[^.;\n]{2,140}"
TARGETED_EQUATIONS = [
    r"(?:For\s+)?h\s*=\s*W0x[^.;\n]{0,80}BAx",
    r"W0\s*\+[^.;\n]{0,24}W\s*=\s*W0\s*\+\s*BA[^.;\n]{0,140}",
    r"store\s+W\s*=\s*W0\s*\+\s*BA[^.;\n]{0,120}",
    r"\bBAx\b[^.;\n]{0,80}",
    r"\bBA\b[^.;\n]{0,100}",
]
CHUNK_EQUATIONS = [r"[A-Za-z0-9˜′'`_]+(?:\s*[A-Za-z0-9˜′'`_()]*)?\s*=\s*[^.;\n]{6,180}", r"O\([^)]{1,80}\)"]
NO_EQUATION = ["table ", "learning rate", "batch size", "max seq", "validation", "accuracy", "wikisql", "mnli", "sam sum", "rouge"]
NO_FORMULA = ["mask parameter", "time-mask ratio", "warm-up", "dropout"]
EQUATION_WORDS = ["where ", "defined as", "denotes", "represents", "composition"]
# Letters and symbols that count in equations, mis-encoded as they are given.
EQUATION_LETTERS = "A-Za-zÎ”âˆ†Î±Î²Ïƒ"
EQUATION_SYMBOLS = ["+", "Î”", "âˆ†", "Ã—", "*", "âˆˆ", "â‰ª", "â‰¤", "â‰¥", "/", "^"]
PAPER_DOMAINS = ["ml", "theory", "systems", "security", "networks", "general"]
FILE_TITLE = r"(?i)(^[0-9]{4}\.[0-9]{5}(v[0-9]+)?$)|(^[0-9a-f-]{20,}$)"
# Words of a text, the loss they stand for, how sure that is, and why; the first rule that is met counts.
LOSS_RULES = [
    (["transducer", "rnnt"], "RNNT", 0.9, "Transducer architectures are typically optimized with RNNT loss."),
    (["gan", "generator", "discriminator"], "adversarial loss", 0.75, "GAN architectures commonly use adversarial objectives."),
    (["diffusion", "denoising"], "denoising loss", 0.75, "Diffusion models are commonly trained with denoising objectives."),
]
AUGMENTATIONS = ["augmentation", "masking", "noise injection", "mixup", "cutmix", "specaugment", "mask"]
AUGMENTATION_NAMES = {"specaugment": "SpecAugment"}
SPEECH_OBJECTIVE = "sequence-to-sequence speech recognition training objective"
CONTRASTIVE_OBJECTIVE = "contrastive representation learning objective"
MASKED_OBJECTIVE = "masked language modeling objective"
OTHER_OBJECTIVE = "training objective centered on "
# End of fixed values.

#: A lexicon that occurs in the invented test corpus, for queries over it.
TEST_ROLES = {"problem": ["the ", "der "], "method": ["and ", "und "], "theory": ["que", "les "], "evaluation": ["in ", "en "], "discussion": ["of ", "of the"], "other": []}
TEST_DOMAINS = {"ml": ["the", "and", "of"], "theory": ["der", "und", "die"], "systems": ["que", "los"], "security": ["token", "license"], "networks": ["le ", "les ", "ment"]}
