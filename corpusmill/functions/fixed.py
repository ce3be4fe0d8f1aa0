"""Word lists, tables, templates and formats that results must equal."""

# Fixed values from here on.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would",
    "should", "could", "may", "might", "can", "this", "that", "what", "how", "why", "when", "where", "for", "in", "on",
    "at", "to", "of", "and", "or", "but", "with", "from",
]
LANGUAGES = {".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".cpp": "cpp", ".c": "c", ".h": "c", ".go": "go", ".rs": "rust"}
READMES, SKIPPED_REMOTE = ["README.md", "README.rst", "README.txt"], ["test", "example", "__pycache__"]
SKIPPED_FOLDERS = ["__pycache__", "node_modules", "venv", "env", ".git", ".github", "tests", "test", "docs", "doc", ".pytest_cache", ".mypy_cache"]
MAX_FILE_SIZE = 102400
MIN_QUESTION, MIN_ANSWER, MIN_TRACE, MIN_CODE = 10, 20, 30, 10
COMPLEXITY_RATIOS = [("simple", 0.40), ("medium", 0.45), ("complex", 0.15)]
SYSTEM_PROMPT = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant specialized in code analysis and software design."
QA_HEADER, DESIGN_HEADER, DEMAND_PREFIX = "\n相关代码:\n", "\n参考代码:\n", "设计需求: "
SNIPPET_FORMAT = ("文件: ", "\n```python\n", "\n```\n\n")
VARIANT_MARKERS = ["with enhanced error handling", "optimized for performance", "with comprehensive logging", "following SOLID principles", "with async support"]
QUESTIONS = {
    "conditional_rule": [
        "What is the business rule for handling {condition} in {file_path}?",
        "How does the code handle {condition} in {file_path}?",
        "What happens when {condition} in {file_path}?",
        "What is the logic behind the condition {condition}?",
        "Why does the code check {condition} in {file_path}?",
        "What is the rule for {condition}?",
        "How is {condition} evaluated in {file_path}?",
        "What does the condition {condition} control in {file_path}?",
    ],
    "function_rule": [
        "How does {function_name} work in {file_path}?",
        "What does the function {function_name} do in {file_path}?",
        "What is the purpose of {function_name} in {file_path}?",
        "How is {function_name} implemented in {file_path}?",
        "What are the parameters of {function_name} in {file_path}?",
        "What does {function_name} return in {file_path}?",
        "What is the behavior of {function_name} in {file_path}?",
        "How does {function_name} handle its inputs in {file_path}?",
    ],
    "class_rule": [
        "What is the design of {class_name} in {file_path}?",
        "How is {class_name} structured in {file_path}?",
        "What does the class {class_name} do in {file_path}?",
        "What is the purpose of {class_name} in {file_path}?",
        "How does {class_name} inherit from its base classes?",
        "What methods does {class_name} provide in {file_path}?",
        "What is the architecture of {class_name} in {file_path}?",
        "How is {class_name} used in {file_path}?",
    ],
    "comment_rule": [
        "What does the comment about {description} mean in {file_path}?",
        "What rule is described in the comment at {file_path}?",
        "What is the note about {description} in {file_path}?",
    ],
}
DEMANDS = [
    "Design a new authentication module based on the repository architecture.",
    "Propose a design for adding rate-limiting to the architecture.",
    "Design a logging system that integrates with the existing codebase.",
    "Propose a caching mechanism based on the current architecture.",
    "Design an error handling module following the repository patterns.",
    "Propose a design for adding monitoring capabilities.",
    "Design a configuration management system.",
    "Propose a design for adding retry logic.",
    "Design a plugin system based on the existing architecture.",
    "Propose a design for adding validation layer.",
]
MORE_DEMANDS = [
    "Design a new authentication module with OAuth2 support based on the repository architecture.",
    "Propose a design for adding distributed rate-limiting to the architecture.",
    "Design a comprehensive logging system with structured logging that integrates with the existing codebase.",
    "Propose a multi-level caching mechanism based on the current architecture.",
    "Design an advanced error handling module with retry logic following the repository patterns.",
    "Propose a design for adding real-time monitoring capabilities.",
    "Design a flexible configuration management system with environment-based settings.",
    "Propose a design for adding circuit breaker pattern with retry logic.",
    "Design an extensible plugin system with hot-reload capability based on the existing architecture.",
    "Propose a design for adding request/response validation layer with schema validation.",
]
CLASS_DEMAND = "Design a new class hierarchy that extends the existing architecture."
# (words of which one is in the lower-cased code, answer); the first that fits, the last fits all.
CONDITION_ANSWERS = [
    (["redirect"], "The library handles redirects based on the condition {condition}. When this condition is met, the system follows redirects automatically. The default behavior can be configured via parameters such as 'allow_redirects' and 'max_redirects' to control the redirect handling mechanism."),
    (["timeout"], "Timeout handling follows the rule defined by {condition}. The system prevents indefinite waits by enforcing timeouts on both connect and read operations. This ensures that requests do not hang indefinitely and provides better reliability for network operations."),
    (["error", "exception"], "Error handling is governed by the condition {condition}. When this condition evaluates to true, the system raises appropriate exceptions or handles errors accordingly. This ensures proper error propagation and allows calling code to handle exceptional situations gracefully."),
    (["method"], "The rule states that when {condition}, the HTTP method is processed and normalized. The system converts the method to uppercase and validates it according to HTTP standards, ensuring consistent method handling throughout the request lifecycle."),
    (["header"], "The condition {condition} controls header processing in the request. When this condition is met, headers are merged, validated, and prepared for the HTTP request. This ensures proper header formatting and prevents header-related errors."),
    ([""], "The rule states that when {condition}, the system performs specific actions as defined in the implementation. This conditional logic ensures that the code behaves correctly based on the current state and input parameters, maintaining the expected functionality of the module."),
]
NO_PARAMETERS, RETURNS, INHERITS, STANDALONE, METHODS = "no parameters", " and returns a value", "inherits from {bases}", "is a standalone class", " with {n} methods"
COMMENT_ANSWER = "The rule states: {description}."
FUNCTION_START = "The function {name} accepts parameters {params}{returns}. "
FUNCTION_DOCUMENTED = " The function implements the logic as described in its documentation and processes the input parameters according to the defined business rules."
FUNCTION_ANSWERS = [
    (["get", "fetch"], "It retrieves or fetches data based on the provided parameters, performing necessary validation and processing before returning the result."),
    (["set", "update"], "It updates or modifies the internal state based on the provided parameters, ensuring data consistency and proper state management."),
    (["check", "validate"], "It performs validation or checking operations on the input parameters, ensuring that the data meets the required criteria before further processing."),
    ([""], "It performs operations based on the input parameters, implementing the core business logic as defined in the codebase. The function handles various scenarios and edge cases to ensure robust functionality."),
]
CLASS_START = "The class {name} {bases}{methods}. "
CLASS_DOCUMENTED = " The class encapsulates related functionality and provides a clean interface for interacting with the underlying implementation, following object-oriented design principles."
CLASS_ANSWERS = [
    (["adapter"], "It implements the adapter pattern, providing an interface for adapting different implementations. This allows the system to work with various backends while maintaining a consistent API."),
    (["handler"], "It implements a handler pattern, processing requests or events in a structured manner. The handler manages the lifecycle and coordinates with other components to fulfill its responsibilities."),
    (["base", "abstract"], "It serves as a base or abstract class, defining the interface and common functionality that derived classes should implement. This promotes code reuse and ensures consistent behavior across implementations."),
    ([""], "It provides functionality following the object-oriented design pattern, encapsulating related data and methods. The class maintains internal state and provides methods for interacting with and manipulating that state."),
]
TRACES = {
    "conditional_rule": "Step 1: Identify conditional logic in {file_path}. Step 2: Analyze the condition and its branches. Step 3: Extract the business rule from the implementation. Conclusion: Rule defines behavior based on specific conditions.",
    "function_rule": "Step 1: Locate function {name} in {file_path}. Step 2: Analyze function parameters and logic. Step 3: Extract business rules from function implementation. Conclusion: Function implements specific business logic.",
    "class_rule": "Step 1: Locate class {name} in {file_path}. Step 2: Analyze class structure and inheritance. Step 3: Extract design patterns and business rules. Conclusion: Class follows object-oriented design principles.",
    "comment_rule": "Step 1: Analyze code structure in {file_path}. Step 2: Extract key components and patterns. Step 3: Identify business rules and logic. Conclusion: Code follows specific design patterns and rules.",
}
VAGUE_TERMS = [
    ("这段代码", "在{file_path}文件的第{line_start}行"), ("该代码", "{file_path}文件第{line_start}行的代码"), ("这里的代码", "{file_path}文件第{line_start}行的代码"),
    ("上述代码", "{file_path}文件第{line_start}行的代码"), ("此代码", "{file_path}文件第{line_start}行的代码"), ("代码片段", "{file_path}文件第{line_start}-{line_end}行的代码"),
    ("这个函数", "{function}"), ("该函数", "{function}"), ("此函数", "{function}"),
    ("这个类", "{file_path}文件第{line_start}行的类"), ("该类", "{file_path}文件第{line_start}行的类"), ("此类", "{file_path}文件第{line_start}行的类"),
    ("这里", "在{file_path}文件的第{line_start}行"), ("此处", "在{file_path}文件的第{line_start}行"), ("该文件", "{file_path}文件"), ("此文件", "{file_path}文件"),
]
# Multiple choice: question, right answers (as above), wrong answers in order, explanation.
CHOICE_QUESTIONS = {"conditional_rule": "What is the business rule for handling {condition} in {file_path}?", "function_rule": "How does {name} work in {file_path}?", "class_rule": "What is the design of {name} in {file_path}?", "comment_rule": "What is the rule for {description}?"}
CHOICE_CONDITION = [
    (["redirect"], "The library handles redirects automatically, with configurable limits via parameters."),
    (["timeout"], "The system enforces timeouts on connect and read operations to prevent indefinite waits."),
    (["error", "exception"], "The system raises appropriate exceptions when the condition is met, ensuring proper error handling."),
    ([""], "When {condition}, the system performs specific actions as defined in the implementation."),
]
CHOICE_FUNCTION = ("The function {name} accepts {params} and implements the logic described in its documentation.", "The function {name} accepts {params} and performs operations based on the input parameters.")
CHOICE_CLASS = "The class {name} {bases} and provides functionality following object-oriented design principles."
WRONG_ANSWERS = {
    "conditional_rule": ["The condition is always false and never executes.", "The system ignores the condition and always takes the else branch.", "The condition is only checked during initialization, not at runtime.", "The system raises an error regardless of the condition value.", "The condition is used for logging purposes only, not for control flow."],
    "function_rule": ["The function {name} does not accept any parameters.", "The function {name} always returns None regardless of input.", "The function {name} is deprecated and should not be used.", "The function {name} only works in debug mode.", "The function {name} requires administrator privileges to execute."],
    "class_rule": ["The class {name} is an abstract class with no concrete implementation.", "The class {name} is only used for testing and not in production code.", "The class {name} inherits from multiple base classes using multiple inheritance.", "The class {name} is a singleton class that can only be instantiated once.", "The class {name} is deprecated and replaced by a newer implementation."],
    "comment_rule": ["The rule is not enforced and can be bypassed.", "The rule only applies in development environment, not in production.", "The rule is optional and can be disabled via configuration.", "The rule is deprecated and no longer used in the current version.", "The rule is only checked when debugging is enabled."],
}
EXPLANATIONS = {
    "conditional_rule": "The correct answer explains the conditional logic in {file_path}. The condition controls the program flow based on specific criteria, ensuring proper behavior of the system.",
    "function_rule": "The correct answer describes how {name} works in {file_path}. Understanding function behavior is crucial for using the API correctly.",
    "class_rule": "The correct answer explains the design of {name} in {file_path}. The class structure follows object-oriented principles to provide the required functionality.",
    "comment_rule": "The correct answer describes the rule in {file_path}. Understanding these rules helps in correctly using and extending the codebase.",
}
# Designs: what a demand asks for, the keywords of code that bears on it, the scheme with and without an adapter in the code base.
DESIGN_KEYWORDS = [(["auth"], ["auth", "authentication", "token", "credential"]), (["rate"], ["adapter", "handler", "send", "request"]), (["log"], ["log", "logger", "debug"]), (["cache"], ["cache", "store", "memory"]), ([""], ["base", "class", "handler"])]
SCHEMES = {
    "auth_adapter": "Integrate an AuthHandler class similar to existing adapters, with methods for token refresh and header injection. Extend Session class to include auth parameter. Follow the adapter pattern used in the codebase for consistency. {place}. The AuthHandler should implement methods like authenticate(), refresh_token(), and inject_headers(). It should integrate seamlessly with the existing request/response cycle and maintain compatibility with current authentication mechanisms.",
    "auth": "Create an AuthHandler class that inherits from a base handler class. {place}. Implement methods for token management and authentication. Integrate with the existing session management system. The handler should support multiple authentication schemes including Basic Auth, Bearer tokens, and custom authentication methods. It should handle token expiration and automatic refresh, ensuring secure and seamless authentication throughout the application lifecycle.",
    "rate_adapter": "Create a RateLimiter adapter that inherits from HTTPAdapter, with a queue and sleep mechanism before send(). {place}. Integrate into Session.mount() following the existing adapter pattern. The rate limiter should support configurable limits per endpoint, sliding window algorithms, and graceful handling of rate limit exceeded scenarios. It should provide metrics and logging capabilities for monitoring rate limit effectiveness.",
    "rate": "Design a RateLimiter class with a token bucket algorithm. {place}. Integrate it into the request pipeline before sending requests. Maintain compatibility with existing request flow. The rate limiter should support multiple rate limiting strategies including fixed window, sliding window, and token bucket. It should handle concurrent requests efficiently and provide clear error messages when limits are exceeded.",
    "logging": "Create a LoggingHandler that integrates with the existing handler system. {place}. Add logging hooks at key points: request preparation, response handling, and error cases. Use a configurable logging level system. The logging handler should support structured logging with context information, log rotation and retention policies, and integration with external logging services. It should provide detailed request/response logging while maintaining performance and privacy considerations.",
    "caching": "Design a CacheManager that can be integrated into the request/response cycle. {place}. Implement cache key generation based on request parameters. Add cache invalidation mechanisms and TTL support. The cache manager should support multiple storage backends including in-memory, Redis, and file-based caching. It should implement cache strategies like LRU, LFU, and time-based expiration. The system should handle cache stampede prevention and provide cache statistics for monitoring.",
    "error": "Create an ErrorHandler class following the existing error handling patterns. {place}. Implement custom exception types and error recovery mechanisms. Integrate with the existing request/response flow. The error handler should support retry strategies with exponential backoff, error classification and categorization, and comprehensive error logging. It should provide user-friendly error messages while maintaining detailed diagnostic information for developers.",
    "inheritance": "Design a new module following the inheritance pattern used in the codebase. {place}. Create base classes and extend them for specific implementations. Maintain consistency with existing architecture. The module should follow the established design patterns, provide clear interfaces, and ensure backward compatibility. It should integrate seamlessly with existing components while providing extensibility for future enhancements.",
    "generic": "Design a modular component that integrates with the existing codebase. {place}. Follow the established patterns and maintain separation of concerns. Ensure compatibility with existing interfaces. The component should be well-documented, testable, and follow the single responsibility principle. It should provide clear APIs and handle edge cases gracefully while maintaining performance and reliability.",
}
PLACES = {
    "auth_adapter": ("Location: Extend existing {file} or create auth_handler.py", "auth.py"), "auth": ("Location: Create auth_handler.py in the same directory as {file}", "existing auth modules"),
    "rate_adapter": ("Location: Create rate_limiter.py in adapters/ directory or extend {file}", "existing adapter file"), "rate": ("Location: Create rate_limiter.py in utils/ or middleware/ directory", ""),
    "logging": ("Location: Create logging_handler.py in utils/ directory or handlers/logging.py", ""), "caching": ("Location: Create cache_manager.py in utils/ directory or cache/cache_manager.py", ""),
    "error_file": ("Location: Extend existing {file} or create error_handler.py in the same directory", ""), "error": ("Location: Create error_handler.py or extend exceptions.py", ""),
    "folder": ("Location: Create new module in {file}/ or extend existing files", ""), "none": ("Location: To be determined based on project structure", ""),
}
# Where a design is put, by its demand, with {file} or without one.
STORAGE = {
    "auth_file": "Create new file: {extended} or extend existing {file}", "auth": "Create new file: auth_handler.py or extend existing auth.py",
    "rate_file": "Create new file: rate_limiter.py or integrate into {file}", "rate": "Create new file: rate_limiter.py or adapters/rate_limiter.py",
    "log": "Create new file: logging_handler.py or utils/logging.py", "cache": "Create new file: cache_manager.py or utils/cache.py",
    "error_file": "Extend existing {file} or create error_handler.py", "error": "Create new file: error_handler.py or extend exceptions.py",
    "folder": "Create new file in {folder}/ or extend {file}",
}
# Traces: (action, evidence, conclusion) of the default steps, summaries, words that mark a step.
PLACE_FORMAT = "{file_path} 第{line_start}行"
RULE_STEPS = [("识别代码结构", PLACE_FORMAT, "识别出代码规则的基本结构"), ("分析业务逻辑", "代码片段内容", "理解代码的业务规则和功能")]
RULE_SUMMARY = "基于代码分析得出的业务规则和逻辑"
DESIGN_STEPS = [("分析现有架构", "代码仓库中的结构信息", "识别出现有架构的设计模式和风格"), ("识别集成点", "{file_path} 中的基类和接口", "找到可以扩展的集成点"), ("设计决策", "现有代码的设计模式", "选择合适的设计方案以保持一致性")]
DESIGN_SUMMARY = "基于现有架构设计满足需求的新模块"
INTEGRATION_POINT = ("src/base.py", "通过继承基类实现新功能", "保持与现有代码的一致性")
STEP_WORDS = ["step", "步骤", "first", "首先", "then", "然后"]
STEP_EVIDENCE, STEP_CONCLUSION, ONLY_STEP, ONLY_CONCLUSION = "代码分析", "基于代码分析得出结论", "分析代码结构", "基于代码分析"
VAGUE_DESIGN_TERMS = [("现有代码", "{file_path}文件中的代码"), ("相关代码", "{file_path}文件中的代码"), ("这段代码", "{file_path}文件中的代码"), ("该代码", "{file_path}文件中的代码"), ("代码库", "代码仓库"), ("现有系统", "现有系统（主要参考{file_path}文件）"), ("相关文件", "{files}等文件"), ("该文件", "{file_path}文件"), ("此文件", "{file_path}文件")]
# Prompts, with {places}; texts for snippets of code.
KINDS = {"conditional_rule": "条件规则", "function_rule": "函数规则", "class_rule": "类规则", "comment_rule": "注释规则"}
CONTEXT_LINES, NO_CONTEXT, NO_ARCHITECTURE = {"class_name": "所属类: ", "name": "函数名: ", "condition": "条件表达式: "}, "无", "无架构信息"
FEEDBACK = "\n\n重要提示：之前的生成未通过验证，失败原因：{feedback}\n请根据以上原因改进生成，确保满足所有要求。"
QA_PROMPT = """你是一个代码分析专家。请基于以下代码片段生成一个高质量的问答对，用于训练代码理解模型。

规则类型: {kind}
文件路径: {file_path}
代码行号: {line_start}-{line_end}
上下文信息:
{context}

代码片段:
```python
{code}
```

请生成一个问答对，要求：
1. 问题应该深入理解代码的业务逻辑和规则（可以是what/how/why类型）
2. 答案必须明确指出代码的具体位置和名称，避免使用"这段代码"、"该代码"等模糊指代
3. 答案中必须明确提及：
   - 文件路径: {file_path}
   - 代码行号: 第{line_start}行到第{line_end}行
   - {function_line}
   - {class_line}
4. 推理trace必须结构化，包含多个步骤，每个步骤要有动作、证据和结论

请以JSON格式输出，格式如下：
{
  "question": "问题内容（必须明确指出文件路径和代码位置）",
  "answer": "答案内容，必须明确引用文件路径、行号、函数名/类名等具体信息，例如：'在{file_path}文件的第{line_start}行'，而不是'这段代码'",
  "reasoning_trace": {
    "steps": [
      {
        "step": 1,
        "action": "识别代码结构（如：识别条件判断、函数定义等）",
        "evidence": "具体证据来源（如：{file_path}文件第{line_start}行的if语句）",
        "conclusion": "基于证据得出的结论"
      },
      {
        "step": 2,
        "action": "分析业务逻辑（如：分析条件表达式的含义）",
        "evidence": "具体证据来源（如：{file_path}文件第{line_start}行条件表达式中的变量名和操作符）",
        "conclusion": "业务规则的具体含义"
      }
    ],
    "summary": "整体推理过程的总结，说明如何从代码得出最终结论"
  }
}

重要要求：
- 问题和答案中必须明确使用文件路径、行号、函数名/类名等具体信息
- 禁止使用"这段代码"、"该代码"、"这里"、"上述代码"等模糊指代
- 使用"在{file_path}文件的第{line_start}行"、"函数{name}"、"类{class_name}"等明确表述
- reasoning_trace.steps 必须至少包含2个步骤
- reasoning_trace.summary 必须至少20字符，总结整体推理过程
- 每个步骤的evidence必须明确指出代码位置（文件路径和行号）
- 步骤之间要有逻辑关联，形成推理链
- 只输出JSON，不要其他内容。"""
DESIGN_PROMPT = """你是一个软件架构设计专家。请基于以下代码仓库的架构，设计一个满足需求的新模块。

设计需求: {demand}

仓库架构信息:
{architecture}

相关代码示例:
{context}

请生成一个详细的设计方案，要求：
1. 方案应该遵循现有代码库的设计模式和架构风格
2. 方案必须明确指出具体的文件路径、类名、函数名等，避免使用"现有代码"、"相关文件"等模糊指代
3. 方案应该详细说明如何集成到现有系统中，明确指出集成点的文件路径和代码位置
4. 方案应该包含具体的实现思路和关键代码结构
5. 推理trace必须结构化，说明设计决策的推理过程

请以JSON格式输出，格式如下：
{
  "scheme": "详细的设计方案内容，必须明确引用文件路径、类名、函数名等具体信息，例如：'在src/base.py文件的BaseHandler类中'，而不是'现有代码'或'相关文件'",
  "reasoning_trace": {
    "steps": [
      {
        "step": 1,
        "action": "分析现有架构（如：识别设计模式、架构风格）",
        "evidence": "具体证据，必须明确指出文件路径和类名（如：src/base.py文件中的BaseHandler类）",
        "conclusion": "现有架构的特点和设计原则"
      },
      {
        "step": 2,
        "action": "识别集成点（如：找到可以扩展的基类或接口）",
        "evidence": "具体证据，必须明确指出文件路径和代码位置（如：src/base.py文件第10-20行的BaseHandler类）",
        "conclusion": "集成点的位置和方式"
      },
      {
        "step": 3,
        "action": "设计决策（如：选择继承还是组合）",
        "evidence": "具体证据，必须明确指出文件路径和设计模式（如：src/base.py文件中的BaseHandler类采用了策略模式）",
        "conclusion": "设计决策的理由和优势"
      }
    ],
    "integration_points": [
      {
        "file": "文件路径（必须是完整的相对路径，如src/base.py）",
        "description": "集成点描述，必须明确指出类名或函数名",
        "rationale": "选择此集成点的理由"
      }
    ],
    "summary": "整体设计思路和关键决策的总结，必须明确引用文件路径和类名"
  }
}

重要要求：
- 禁止使用"现有代码"、"相关文件"、"这段代码"、"该代码"等模糊指代
- 必须明确使用文件路径（如：src/base.py）、类名（如：BaseHandler）、函数名（如：process_request）等具体信息
- reasoning_trace.steps 必须至少包含3个步骤
- reasoning_trace.summary 必须至少20字符，总结整体设计思路
- integration_points 必须包含具体的文件路径和集成方式
- 每个步骤的evidence必须明确指出代码位置（文件路径和行号）或架构特征（类名、函数名）
- 只输出JSON，不要其他内容。"""
SCHEME_DEFAULT, POINT_DESCRIPTION, POINT_RATIONALE = "Generated by LLM", "Integration point: {file}", "Based on architecture analysis"
# Of a snippet: (question, answer) where it holds a function, else a class, else neither; of other languages.
SNIPPET_QA = {
    "function": ("What does the function {name} do in {file_path}?", "The function {name} performs operations as defined in {file_path}. It processes the input according to the implementation logic."),
    "class": ("What is the purpose of class {name} in {file_path}?", "The class {name} provides functionality related to the module's purpose."),
    "code": ("What is the purpose of the code in {file_path}?", "The code in {file_path} implements specific functionality for the module."),
    "other": ("What does the code in {file_path} do?", "The code implements functionality in {file_path}."),
}
SNIPPET_TRACE = "Step 1: Analyze code structure in {file_path}. Step 2: Identify key components and logic. Step 3: Extract business rules and patterns. Conclusion: Code implements specific functionality."
SNIPPET_RULES = {
    "conditional_rule": ("What is the business rule for handling {name} in {file_path}?", "The code checks {name} and performs actions based on this condition."),
    "function_rule": ("How does {name} work in {file_path}?", "The function {name} performs operations as defined in {file_path}."),
    "class_rule": ("What is the design of {name} in {file_path}?", "The class {name} provides functionality related to the module's purpose."),
}
SNIPPET_RULE_TRACE = "Step 1: Analyze code structure in {file_path}. Step 2: Identify {rule_type} patterns. Step 3: Extract business rules. Conclusion: Code implements specific functionality."
SNIPPET_RIGHT = {"function": "The function {name} performs operations as defined in {file_path}.", "class": "The class {name} provides functionality related to the module's purpose."}
SNIPPET_WRONG = {
    "function": ["The function {name} is used for error handling only.", "The function {name} manages database connections.", "The function {name} handles user authentication."],
    "class": ["The class {name} is only used for testing purposes.", "The class {name} handles network communication exclusively.", "The class {name} manages file system operations."],
}
SNIPPET_EXPLANATION = "This question tests understanding of the code structure in {file_path}."
# A design's reasoning: the steps in order, those in pairs or more by what there is.
REASONING = {
    "patterns": "Step 1: Analyze existing architecture patterns: {list}. ", "no patterns": "modular design",
    "bases": "Step 2: Identify base classes for extension: {list}. ", "points": "Step 2: Identify extension points: {list}. ", "neither": "Step 2: Review codebase structure for integration points. ",
    "files": "Step 3: Reference existing files: {list}. ", "rest": "Step 4: Propose extension following existing patterns. Step 5: Ensure compatibility with current architecture. ",
    "storage": "Step 6: Recommended storage location: {list}. ", "end": "Conclusion: Modular design maintains warehouse architecture consistency.",
}
