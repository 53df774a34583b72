"""millrace: corpus curation and labelling as DataFrame plans."""
