"""Multi-operator plans: experiments, curation, checkpoints."""
