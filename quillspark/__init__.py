"""quillspark: quoting and drawing-text analytics on Spark DataFrames, with training-data operators in ``llm``."""
