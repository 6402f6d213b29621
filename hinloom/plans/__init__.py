"""Multi-step network analyses built from the operators."""
