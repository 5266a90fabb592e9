"""Initial challenge phrases."""

# The seeded phrase texts.
PHRASES = [
    "La biometria de voz es una tecnologia innovadora que protege tu identidad de manera unica y segura",
    "Tu voz es tan unica como tu huella digital y representa la mejor forma de autenticacion personal",
    "Cada vez que hablas, tu voz crea un patron biometrico imposible de replicar por otra persona",
    "La seguridad de tus datos personales comienza con la autenticacion biometrica basada en tu voz natural",
    "Proteger tu identidad digital nunca fue tan facil gracias a la tecnologia de reconocimiento de voz avanzada",
    "La biometria vocal analiza caracteristicas unicas de tu voz que son imposibles de falsificar completamente",
    "Tu voz contiene miles de caracteristicas acusticas que te identifican de forma precisa y confiable",
    "El futuro de la seguridad digital esta en la autenticacion multimodal que incluye tu voz personal",
    "Cada palabra que pronuncias genera un patron espectral unico que funciona como tu firma digital personal",
    "La tecnologia de reconocimiento de voz hace que tus conversaciones sean la llave de tu seguridad digital",
    "Confiar en tu voz para autenticarte es confiar en la tecnologia mas avanzada de seguridad biometrica actual",
    "Los sistemas biometricos de voz analizan frecuencias y resonancias que son exclusivas de cada ser humano",
    "Tu voz es la contrasena mas segura porque combina aspectos fisicos y comportamentales unicos de tu persona",
    "La autenticacion por voz elimina la necesidad de recordar contrasenas complejas y dificiles de memorizar siempre",
    "Cada tono y modulacion de tu voz cuenta una historia unica que solo tu puedes narrar autentica",
    "La biometria vocal representa un avance tecnologico que revoluciona la forma en que protegemos nuestra identidad digital",
    "Tu voz es un instrumento biometrico natural que te seguira siempre sin necesidad de dispositivos adicionales externos",
    "Los algoritmos de procesamiento de voz extraen caracteristicas que hacen tu perfil vocal completamente irrepetible y seguro",
    "La seguridad biometrica basada en voz ofrece comodidad y proteccion sin comprometer la privacidad de los usuarios",
    "Cada registro de tu voz fortalece el modelo biometrico que garantiza una autenticacion mas precisa y confiable",
    "La tecnologia de texto dinamico asegura que cada autenticacion sea diferente evitando ataques de reproduccion de audio",
    "Tu voz es la manifestacion sonora de tu identidad fisica que ningun impostor puede replicar fielmente completa",
    "Los sistemas multimodales combinan voz con otras biometrias para crear capas de seguridad practicamente impenetrables hoy",
    "Autenticarte con tu voz es tan natural como hablar porque utilizas algo que siempre llevas contigo",
    "La precision de los sistemas de reconocimiento de voz modernos supera el noventa y nueve por ciento garantizado",
    "Cada frecuencia fundamental de tu voz es determinada por la estructura unica de tu aparato fonador personal",
    "La biometria de voz funciona incluso cuando tienes un resfriado leve porque analiza multiples caracteristicas acusticas complementarias",
    "Tu patron vocal es tan distintivo que puede identificarte entre millones de personas con exactitud impresionante cientifica",
    "Los coeficientes MFCC extraidos de tu voz capturan la esencia acustica que define tu identidad vocal unica",
    "La autenticacion biometrica de voz es el equilibrio perfecto entre seguridad robusta y facilidad de uso cotidiano",
    "Cada ves que pronuncias una frase el sistema aprende mas sobre tu perfil vocal mejorando continuamente",
    "La tecnologia de reconocimiento de locutor distingue tu voz de imitaciones y grabaciones fraudulentas con precision notable",
    "Tu voz transporta informacion biometrica en cada fonema que pronuncias creando una firma acustica personal inigualable siempre",
    "Los algoritmos de aprendizaje automatico transforman tu voz en vectores numericos que representan tu identidad digital segura",
    "La biometria vocal democratiza el acceso a sistemas seguros sin requerir hardware especializado costoso o complicado para usuarios",
    "Cada caracteristica espectral de tu voz es un elemento del rompecabezas que forma tu perfil biometrico completo",
    "La autenticacion por voz con texto dinamico garantiza que cada validacion sea un desafio nuevo e irrepetible siempre",
    "Tu voz es el resultado de la combinacion unica de tu anatomia vocal y tus patrones de habla aprendidos",
    "Los sistemas biometricos de voz protegen contra el fraude utilizando analisis en tiempo real de multiples parametros acusticos",
    "Cada autenticacion exitosa con tu voz refuerza la confianza del sistema en tu identidad legitima y autentica",
    "La biometria de voz es una tecnologia no invasiva que respeta tu privacidad mientras protege tu seguridad digital",
    "Tu tracto vocal actua como un filtro acustico unico que modula el sonido de manera irrepetible para otros",
    "Los sistemas modernos de reconocimiento de voz son robustos ante ruido ambiental y variaciones en el canal de transmision",
    "Cada muestra de audio que proporcionas contribuye a crear un modelo biometrico mas preciso y confiable para ti",
    "La autenticacion multimodal que incluye voz ofrece seguridad en capas que es extremadamente dificil de comprometer totalmente",
    "Tu voz es una biometria comportamental que refleja no solo tu fisiologia sino tambien tu forma unica de expresarte",
    "Los vectores de caracteristicas extraidos de tu voz forman una representacion matematica unica de tu identidad vocal personal",
    "La tecnologia de texto dinamico evita ataques de repeticion obligando a pronunciar frases nuevas en cada autenticacion siempre",
    "Tu voz es la herramienta biometrica mas conveniente porque siempre esta disponible sin necesidad de dispositivos fisicos adicionales",
    "Cada parametro acustico de tu voz contribuye a la construccion de un perfil biometrico robusto y seguro definitivo",
]
