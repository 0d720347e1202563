"""Long-read mapping and scaffolding as DataFrame programs."""
